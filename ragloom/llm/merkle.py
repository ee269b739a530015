"""A Merkle manifest of a dataset, reduced by superblocks.

Leaves are numbered within their group; a superblock is the run of `fanout ** levels` nodes with one quotient of their numbers.
One `applyInPandas` collapses a superblock by `levels` levels and writes each node's lower proof; the superblocks' roots are the
nodes of the next round, until a group has one. A node's proof is its lower proof, then that of its superblock's root. Groups'
roots, in order of their names, are reduced the same way to the root of all.

A level hashes every `fanout` consecutive nodes (the last run: fewer, even one) as long as a group has several. A proof has, for each
level, the hashes before and after the node in its run, so it folds from any leaf by hashing alone.

Scale: texts are hashed where they are read and never move; leaves are numbered through ranges of their order's key, cut at its
quantiles, so that no window holds a group; a task collapses one superblock at a time. Each round is a table in the shared folder.

Defined results: a null group comes first; null values are `-`; null doc_ids come first; repeated doc_ids go by their leaf;
equal rows are leaves each, with equal hashes and each its own place; texts of any length are hashed whole; an only leaf is its group's
root; an empty table has no rows; columns other than the five are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FANOUT = 2
LEVELS = 10
ROWS_PER_RANGE = 2_000
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value) -> F.Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed) -> F.Column:
    """Hash of a row; `changed` gives a column other values."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def depth(n: int, fanout: int) -> int:
    """Levels from `n` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def numbered(leaves: DataFrame) -> DataFrame:
    """`leaves` (g, doc_id, node, ...) with `idx`, their place in g by (doc_id, node), and `size`, the leaves of g."""
    ranged = common.with_range(leaves, "doc_id", "range", leaves.count(), ROWS_PER_RANGE)
    counts = ranged.groupBy("g", "range").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("range") / 512))
    spans = counts.groupBy("g", "span").agg(F.sum("n").alias("n"))
    spans = spans.selectExpr("g", "span", "sum(n) over (partition by g order by span) - n as before", "sum(n) over (partition by g) as size")
    starts = counts.join(spans, ["g", "span"])
    starts = starts.selectExpr("g", "range", "size", "before + sum(n) over (partition by g, span order by range) - n as start")
    place = "row_number() over (partition by g, range order by doc_id nulls first, node) - 1"
    placed = ranged.selectExpr("*", f"{place} as place")
    return placed.join(starts, ["g", "range"]).withColumn("idx", F.col("start") + F.col("place")).drop("range", "start", "place")


def collapse(levels: int, fanout: int):
    """A superblock's nodes with their lower proofs and its root, for applyInPandas."""

    def run(block):
        from hashlib import sha256

        block = block.sort_values("idx", kind="stable")
        nodes = block["node"].tolist()
        at = list(range(len(nodes)))
        before, after = [[] for _ in at], [[] for _ in at]
        for _ in range(min(levels, depth(int(block["size"].iloc[0]), fanout))):
            for i, o in enumerate(at):
                first = o - o % fanout
                before[i].append("".join(nodes[first:o]))
                after[i].append("".join(nodes[o + 1 : first + fanout]))
                at[i] = o // fanout
            nodes = [sha256("".join(nodes[s : s + fanout]).encode()).hexdigest() for s in range(0, len(nodes), fanout)]
        return block.assign(before=before, after=after, top=nodes[0])

    return run


def prove(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """`nodes` (g, idx, node, size, and columns of strings or numbers without nulls) with `before` and `after`, the siblings of each
    level up to the root of g, and `top`, that root."""
    common.ship(nodes.sparkSession)
    span = fanout**levels
    nodes = nodes.withColumn("block", F.floor(F.col("idx") / span))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    lower = nodes.groupBy("g", "block").applyInPandas(collapse(levels, fanout), f"{columns}, before array<string>, after array<string>, top string")
    lower = common.materialise(lower, "merkle")
    largest = lower.agg(F.max("size")).first()[0] or 0
    if largest <= span:
        return lower.drop("block")
    roots = lower.where(F.col("idx") % span == 0)
    roots = roots.select("g", F.col("block").alias("idx"), F.col("top").alias("node"), F.ceil(F.col("size") / span).alias("size"))
    upper = prove(roots, levels, fanout).selectExpr("g", "idx as block", "before as u_before", "after as u_after", "top as u_top")
    joined = lower.join(upper, ["g", "block"])
    whole = {"before": F.concat("before", "u_before"), "after": F.concat("after", "u_after"), "top": F.col("u_top")}
    return joined.withColumns(whole).drop("block", "u_before", "u_after", "u_top")


def fold(start, before, after) -> F.Column:
    """The root that a proof leads to from the leaf `start`."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), start, lambda h, p: F.sha2(F.concat(p["b"], h, p["a"]), 256))


def proof_hash(before, after) -> F.Column:
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def manifest(leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """`leaves` (g, doc_id, node and columns of strings) with `before`, `after` up to the root of all, `subroot` and `root`. g is never
    null; groups go by its bytes."""
    placed = numbered(leaves).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    proved = prove(placed, levels, fanout)
    tops = proved.where("idx = 0").selectExpr("g as name", "top as node")
    # one row per group, not per leaf
    tops = tops.selectExpr("'' as g", "name", "node", "cast(row_number() over (order by name) - 1 as bigint) as idx", "count(*) over () as size")
    high = prove(tops, levels, fanout).selectExpr("name as g", "before as u_before", "after as u_after", "top as root")
    joined = proved.join(high, "g").withColumnRenamed("top", "subroot")
    whole = {"before": F.concat("before", "u_before"), "after": F.concat("after", "u_after"), "doc_id": F.expr("cast(nullif(doc_id, '') as bigint)")}
    return joined.withColumns(whole).drop("u_before", "u_after", "size")


def report(docs: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """The contract's columns: every document's hashes, and the root that its proof leads to after the rule's tampering."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).otherwise(leaf())
    group = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    rows = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"), changed.alias("given"))
    found = manifest(common.materialise(rows, "leaves"), levels, fanout)
    before, after = F.col("before"), F.col("after")
    found = found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_hash(before, after).alias("proof_sha256"), fold(F.col("given"), before, after).alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    def h(n_chars: str) -> str:
        columns = [n_chars if c == "n_chars" else c for c in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')" for c in columns) + ")"

    level = "select g, max(l) + 1 as l, i // 2 as i, sha256(string_agg(h, '' order by i)) as h, (max(n) + 1) // 2 as n from {0} where n > 1 group by g, i // 2"
    step = """select f.id, f.g, f.l + 1, f.i // 2, (f.n + 1) // 2, sha256(case when f.i % 2 = 1 then s.h || f.acc else f.acc || coalesce(s.h, '') end), f.proof || coalesce(s.h, '')
  from {0} f left join {1} s on s.g = f.g and s.l = f.l and s.i = xor(f.i, 1) where f.n > 1"""
    return f"""
with recursive d as (
  select doc_id, coalesce('+' || lang, '') as g, {h("n_chars")} as leaf,
    case when coalesce({common.crc32_sql("doc_id::varchar")} % 7 = 0, false) then {h("n_chars + 1")} else {h("n_chars")} end as given from documents),
p as (select *, row_number() over (order by g, doc_id nulls first, leaf) as id, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from d),
low as (select g, 0 as l, i, leaf as h, n from p union all {level.format("low")}),
tops as (select g as name, '' as g, 0 as l, row_number() over (order by g) - 1 as i, h, count(*) over () as n from low where n = 1),
high as (select g, l, i, h, n from tops union all {level.format("high")}),
f as (select id, g, 0 as l, i, n, given as acc, '' as proof from p union all {step.format("f", "low")}),
e as (select f.id, t.g, 0 as l, t.i, t.n, f.acc, f.proof from f join tops t on t.name = f.g where f.n = 1 union all {step.format("e", "high")})
select p.doc_id, p.leaf, t.h as subroot, r.h as root, sha256(e.proof) as proof_sha256, e.acc as folded_root, e.acc = r.h as verified
from p join e on e.id = p.id and e.n = 1 join tops t on t.name = p.g, (select h from high where n = 1) r"""
