"""Incremental maintenance of a left outer join by a lineage-indexed materialised view.

The view stores which left row met which right row, as pairs of their identities, and the left rows that met none (orphans, a pair
without a right identity). It is laid out twice, by the left and by the right identity, so that a delta finds the pairs that depend
on it from either side. A batch removes the pairs of changed rows, reinserts those of their new states, moves left rows that lost
their last pair or got their first one in and out of the orphans, and sums the net copies of each joined row.

An `Index` is an append-only log: one segment per batch, rows signed +1 or -1, in folders by a hash of one column. The live rows of some
values are those whose signs sum to 1; only the folders of these values are read where the delta is small enough for Spark to
prune them. A batch that runs again after a failure overwrites its own segment. `View.compact` rewrites the logs as one segment.

Rows have an identity (`id`), a join key, a printed part and a number of copies: equal rows are one identity with copies, so a group of
thousands of copies is one pair. Work and shuffles of a batch follow the delta and the pairs that depend on it; nothing goes
through the driver, one task or a broadcast that Spark doesn't size at run time. A key of many distinct rows on both sides has as many
pairs as their product, which is what this method stores; such joins are split by adaptive execution.

Defined results: a null key meets nothing; rows without an identity are refused by `View` and left out by `report`, whose rule never
changes them; a delta that leaves a row as it was changes nothing; a delta of no rows gives no rows; a literal `null` prints like a null;
empty tables give empty results; other columns are ignored, texts aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BATCHES = 5
PADDED = "-"
FOLDERS, ROWS_PER_FOLDER = 8, 500_000
ROW = "id string, key long, part string, copies long"
PAIR = "left_id string, right_id string, key long, left_part string, right_part string, left_copies long, right_copies long"
NET = "key long, left_part string, right_part string, weight long"


class Index:
    """A signed log of rows (`schema`), in folders by a hash of the column `on`."""

    def __init__(self, spark: SparkSession, name: str, on: str, schema: str, sign: str = "sign", folders: int = FOLDERS):
        self.spark, self.on, self.sign, self.folders = spark, on, sign, folders
        self.schema = schema if sign in schema else f"{schema}, {sign} int"
        self.columns = [c.split()[0] for c in self.schema.split(", ") if c.split()[0] != sign]
        self.path = common.scratch(spark, name)

    def folder(self) -> F.Column:
        return F.pmod(F.xxhash64(self.on), F.lit(self.folders)).cast("int").alias("folder")

    def append(self, segment: int, rows: DataFrame) -> None:
        rows = rows.select(*self.columns, self.sign, self.folder()).repartitionById(self.folders, F.col("folder"))
        rows.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/segment={segment}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, segment int, folder int").parquet(self.path)

    def of(self, values: DataFrame) -> DataFrame:
        """Log rows whose column `on` is among `values`."""
        wanted = values.select(self.on).distinct().withColumn("folder", self.folder())
        return self.read().join(wanted, ["folder", self.on], "left_semi")

    def live(self, values: DataFrame | None = None) -> DataFrame:
        found = self.read() if values is None else self.of(values)
        return found.groupBy(*self.columns).agg(F.sum(self.sign).alias("net")).where("net > 0").drop("net")


def pairs(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Pairs of two tables of rows by key; unmatched left rows as orphans where `how` is left."""
    a = left.selectExpr("id as left_id", "key", "part as left_part", "copies as left_copies")
    b = right.selectExpr("id as right_id", "key", "part as right_part", "copies as right_copies")
    joined = a.join(b, "key", how)
    padded = {"right_part": F.when(F.col("right_id").isNull(), F.lit(PADDED)).otherwise(F.col("right_part")), "right_copies": F.coalesce("right_copies", F.lit(1))}
    return joined.withColumns(padded).select("left_id", "right_id", "key", "left_part", "right_part", "left_copies", "right_copies")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


class View:
    """The join of two tables of rows (ROW), whose identities are unique and not null."""

    def __init__(self, left: DataFrame, right: DataFrame):
        spark = left.sparkSession
        rows = left.count() + right.count()
        folders = max(FOLDERS, -(-rows // ROWS_PER_FOLDER))
        index = lambda name, on, schema, sign="sign": Index(spark, name, on, schema, sign, folders)
        self.left, self.right = index("left", "key", ROW), index("right", "key", ROW)
        self.by_left, self.by_right = index("by-left", "left_id", PAIR), index("by-right", "right_id", PAIR)
        self.net = index("net", "key", NET, "weight")
        self.segment = 0
        self.left.append(0, signed(left, 1))
        self.right.append(0, signed(right, 1))
        self._store(signed(pairs(self.left.live(), self.right.live(), "left"), 1))

    def _store(self, changes: DataFrame) -> None:
        """Signed pairs into both indexes, their net copies into the net log."""
        t = self.segment
        self.by_left.append(t, changes)
        stored = self.by_left.read().where(F.col("segment") == t)
        self.by_right.append(t, stored.where("right_id is not null"))
        net = stored.groupBy("key", "left_part", "right_part").agg(F.sum(F.col("sign") * F.col("left_copies") * F.col("right_copies")).alias("weight"))
        self.net.append(t, net.where("weight <> 0"))

    def apply(self, left: DataFrame, right: DataFrame) -> None:
        """One batch. left, right: (id, before, after), structs (key, part, copies) of each changed row; null where it is absent."""
        self.segment = t = self.segment + 1
        state = lambda d, which: d.where(F.col(which).isNotNull()).select("id", f"{which}.*")
        for log, delta in ((self.left, left), (self.right, right)):
            log.append(t, signed(state(delta, "before"), -1).unionByName(signed(state(delta, "after"), 1)))
        left_ids, right_ids = left.selectExpr("id as left_id"), right.selectExpr("id as right_id")
        new_left, new_right = state(left, "after"), state(right, "after")
        # changed left rows: all their pairs go, all new ones come
        gone = signed(self.by_left.live(left_ids), -1)
        come = signed(pairs(new_left, self.right.live(new_left), "left"), 1)
        # unchanged left rows: pairs with changed right rows
        lost = signed(self.by_right.live(right_ids), -1)
        found = signed(pairs(self.left.live(new_right), new_right, "inner"), 1)
        moved = common.materialise(lost.unionByName(found).join(left_ids, "left_id", "left_anti"), "moved")
        touched = moved.groupBy("left_id").agg(F.sum("sign").alias("change"))
        held = self.by_left.live(touched).groupBy("left_id", "key", "left_part", "left_copies").agg(F.count("right_id").alias("pairs"))
        after = F.col("pairs") + F.col("change")
        orphan = F.when((F.col("pairs") == 0) & (after > 0), -1).when((F.col("pairs") > 0) & (after == 0), 1)
        orphans = held.join(touched, "left_id").withColumn("sign", orphan).where("sign is not null")
        orphans = orphans.selectExpr("left_id", "cast(null as string) as right_id", "key", "left_part", f"'{PADDED}' as right_part", "left_copies", "1L as right_copies", "sign")
        self._store(gone.unionByName(come).unionByName(moved).unionByName(orphans))
        common.drop(moved)

    def history(self) -> DataFrame:
        """(segment, key, left_part, right_part, weight, total): joined rows whose copies changed in each segment since the last
        compaction, and their copies after it."""
        running = "sum(weight) over (partition by key, left_part, right_part order by segment rows between unbounded preceding and current row)"
        return self.net.read().selectExpr("segment", "key", "left_part", "right_part", "weight", f"{running} as total")

    def rows(self) -> DataFrame:
        """The join's rows as they are now, with their copies."""
        now = self.net.read().groupBy("key", "left_part", "right_part").agg(F.sum("weight").alias("copies"))
        return now.where("copies <> 0")

    def compact(self) -> None:
        """Rewrite every log as one segment. Readers of the old ones must be done; the new paths are used once all are written."""
        spark, made = self.left.spark, {}
        for name in ("left", "right", "by_left", "by_right", "net"):
            old = getattr(self, name)
            made[name] = new = Index(spark, name, old.on, old.schema, old.sign, old.folders)
            new.append(self.segment, signed(old.live(), 1) if name != "net" else self.rows().withColumnRenamed("copies", "weight"))
        self.__dict__.update(made)


def trajectory(rows: DataFrame, letter: str, state) -> DataFrame:
    """(id, states): rows (doc_id, id, ...) with their state, null while absent, before the first and after each batch of the rule.
    `state` makes a struct of a number of updates."""
    c = lambda t: F.crc32(F.concat(F.lit(f"{letter}:"), F.col("doc_id").cast("string"), F.lit(f":{t}")))
    rows = rows.withColumns({"here": c(0) % 3 != 0, "updates": F.lit(0)})
    states = []
    for t in range(BATCHES + 1):
        if t:
            event = c(t) % 11
            rows = rows.withColumn("updates", F.col("updates") + ((event == 1) & F.col("here")).cast("int"))
            rows = rows.withColumn("here", F.col("here") != (event == 0))
        rows = rows.withColumn(f"s{t}", F.when(F.col("here"), state(F.col("updates"))))
        states.append(f"s{t}")
    return rows.select("id", F.array(*states).alias("states"))


def deltas(paths: DataFrame, t: int) -> DataFrame:
    """What batch `t` changes among the rows of a trajectory."""
    before, after = F.col("states")[t - 1], F.col("states")[t]
    return paths.where(~before.eqNullSafe(after)).select("id", before.alias("before"), after.alias("after"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: the view through the rule's batches."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    half = F.shiftright("doc_id", 1)
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("part"))
    left = docs.where("doc_id is not null").select("doc_id", whole("lang").alias("part")).groupBy("doc_id", "part").agg(F.count("*").alias("copies"))
    state = lambda updates: F.struct((half + updates).alias("key"), F.col("part"), F.col("copies"))
    left = trajectory(left.withColumn("id", name), "d", state)
    right = labels.where("doc_id is not null").groupBy("doc_id", "quality", "toxic").agg(F.count("*").alias("copies"))
    right = right.withColumn("part", F.concat(whole("quality"), F.lit(","), whole("toxic")))
    flipped = lambda updates: F.when(updates % 2 == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("string")
    printed = lambda updates: F.concat(F.coalesce(flipped(updates), F.lit("null")), F.lit(","), whole("toxic"))
    state = lambda updates: F.struct(half.alias("key"), printed(updates).alias("part"), F.col("copies"))
    right = trajectory(right.withColumn("id", name), "l", state)
    left, right = common.materialise(left, "left-paths"), common.materialise(right, "right-paths")
    first = lambda paths: paths.where(F.col("states")[0].isNotNull()).select("id", F.col("states")[0].alias("s")).select("id", "s.*")
    view = View(first(left), first(right))
    for t in range(1, BATCHES + 1):
        view.apply(deltas(left, t), deltas(right, t))
    out = view.history().where("segment > 0")
    return out.selectExpr("segment as batch", "key as join_key", "left_part as doc_part", "right_part as label_part", "weight", "total")


def oracle_sql() -> str:
    def states(table: str, letter: str, columns: str) -> str:
        c = lambda t: common.crc32_sql(f"('{letter}:' || doc_id || ':' || {t})")
        first = f"select 0 as t, {columns}, {c(0)} % 3 <> 0 as here, 0 as updates from {table} where doc_id is not null"
        event = f"{c('t + 1')} % 11"
        return f"{first} union all select t + 1, {columns}, here <> ({event} = 0), updates + case when here and {event} = 1 then 1 else 0 end from {letter} where t < {BATCHES}"

    copies = "select t, join_key, doc_part, label_part, count(*) as n from joined group by all"
    return f"""
with recursive d as ({states("documents", "d", "doc_id, lang")}),
l as ({states("labels", "l", "doc_id, quality, toxic")}),
a as (select t, floor(doc_id / 2)::bigint + updates as join_key, coalesce(lang, 'null') as doc_part from d where here),
b as (select t, floor(doc_id / 2)::bigint as join_key, coalesce((case when updates % 2 = 1 then 1 - quality else quality end)::varchar, 'null') || ',' || coalesce(toxic::varchar, 'null') as label_part from l where here),
joined as (select a.t, a.join_key, doc_part, coalesce(label_part, '-') as label_part from a left join b on a.t = b.t and a.join_key = b.join_key),
n as ({copies}),
changed as (select coalesce(x.t, y.t + 1) as batch, coalesce(x.join_key, y.join_key) as join_key, coalesce(x.doc_part, y.doc_part) as doc_part,
  coalesce(x.label_part, y.label_part) as label_part, coalesce(x.n, 0) - coalesce(y.n, 0) as weight, coalesce(x.n, 0) as total
  from n x full join n y on x.t = y.t + 1 and x.join_key = y.join_key and x.doc_part = y.doc_part and x.label_part = y.label_part)
select batch::int as batch, join_key, doc_part, label_part, weight, total from changed where batch between 1 and {BATCHES} and weight <> 0"""
