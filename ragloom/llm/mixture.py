"""Mixing sources to target weights: hierarchical budgeting, in DataFrame and SQL functions only.

The tree has one level per column of `LEVELS` (domain, language, source). A node's target is its parent's budget times its
weight's share among its siblings; its capacity is the tokens below it times `max_epochs`. What a node can't take goes to its
siblings by weight, and as capacities are those of whole subtrees, a shortage reaches an ancestor's siblings only
when all siblings are full. The closed form of this water filling needs one window per level: siblings in order of
capacity over weight, of which a first part is full and the rest shares what is left by weight.

A leaf of T tokens and budget B takes each document B div T times, and of the next epoch's order, by a seeded hash of doc_id,
the documents of the longest prefix whose tokens stay within B mod T. The prefix's end is found by radix: tokens per leaf and
leading hash bits, then per next bits within the one bucket that holds the end, then row by row within a bucket of
that; no window ever holds a whole leaf.

Weights, tokens and budgets are 64-bit integers; a product beyond them raises an error.

Defined results: a null text has no tokens; null languages and sources are the leaf `unknown`; rows that share doc_id and leaf are one
unit of selection (a null doc_id too); empty tables give an empty selection; other columns are carried along in `select`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
#: Target weights by level and name; other names weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}}
SEED = "mix-1"
BITS = 6
HASH_BITS = 60


def with_leaf(docs: DataFrame) -> DataFrame:
    """`docs` with domain, lang and source filled in; a source's domain is a fixed function of its name."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    domain = F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 4), 16, 10).cast("int") % 4).cast("string"))
    return docs.withColumns({"source": source, "lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "domain": domain})


def _weight(level: str, weights: dict) -> F.Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, numerator: int, denominator: int, max_epochs: int, weights: dict, levels: list[str] = LEVELS) -> DataFrame:
    """Leaf rows (levels, tokens) with their budget, for numerator/denominator of all tokens."""
    level = leaves.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    level = level.withColumn("cap", F.col("tokens") * F.lit(max_epochs).cast("long"))
    budget = level.agg(F.sum("tokens").alias("t"), F.sum("cap").alias("c")).selectExpr("'all' as root", f"least(t * {numerator}L div {denominator}L, c) as budget")
    parents = budget
    for depth in range(1, len(levels) + 1):
        above, name = ["root", *levels[: depth - 1]], levels[depth - 1]
        nodes = level.withColumn("root", F.lit("all")).groupBy(*above, name).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, weights))
        nodes = nodes.join(parents, above)
        key = ", ".join(above)
        order = f"over (partition by {key} order by cap / w, {name} rows between unbounded preceding and 1 preceding)"
        nodes = nodes.selectExpr("*", f"coalesce(sum(cap) {order}, 0L) as c_before", f"sum(w) over (partition by {key}) - coalesce(sum(w) {order}, 0L) as w_left")
        nodes = nodes.withColumn("full", F.expr("cap * w_left <= w * (budget - c_before)"))
        rest = f"(budget - coalesce(sum(if(full, cap, 0L)) over (partition by {key}), 0L))"
        share = f"sum(if(full, 0L, w)) over (partition by {key})"
        nodes = nodes.selectExpr(*above, name, f"if(full, cap, (w * {rest}) div greatest({share}, 1L)) as budget")
        parents = nodes
    return leaves.join(parents.drop("root"), levels)


def units(docs: DataFrame) -> DataFrame:
    counted = with_leaf(docs.select("doc_id", "lang", "source", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), *LEVELS, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")
    )
    return counted.groupBy("doc_id", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))


def choose(docs: DataFrame, numerator: int = 1, denominator: int = 2, max_epochs: int = 2, weights: dict | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of every chosen unit."""
    weights = WEIGHTS if weights is None else weights
    unit = common.materialise(units(docs), "units")
    leaves = unit.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = common.materialise(allocate(leaves, numerator, denominator, max_epochs, weights), "leaves")
    leaves = leaves.where("budget > 0 and tokens > 0").selectExpr(*LEVELS, "budget div tokens as epochs", "budget % tokens as rest")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = unit.join(leaves, LEVELS).withColumn("h", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"))
    dealt = dealt.withColumn("b1", F.shiftright("h", HASH_BITS - BITS)).withColumn("b2", F.shiftright("h", HASH_BITS - 2 * BITS) % (1 << BITS))
    dealt = common.materialise(dealt, "dealt")

    def ends(rows: DataFrame, bucket: str) -> DataFrame:
        sums = rows.groupBy(*LEVELS, "rest", bucket).agg(F.sum("n_tokens").alias("t"))
        order = f"over (partition by {', '.join(LEVELS)} order by {bucket} rows between unbounded preceding and 1 preceding)"
        sums = sums.selectExpr("*", f"coalesce(sum(t) {order}, 0L) as before")
        return sums.selectExpr(*LEVELS, bucket, "before", "before + t <= rest as whole", "before <= rest and before + t > rest as ends")

    first = ends(dealt, "b1").withColumnRenamed("before", "before1")
    tagged = dealt.join(first, [*LEVELS, "b1"])
    settled = tagged.where("not ends").selectExpr("doc_id", *LEVELS, "n_tokens", "epochs + if(whole, 1, 0) as copies")
    open1 = common.materialise(tagged.where("ends").withColumn("rest", F.col("rest") - F.col("before1")).drop("before1", "whole", "ends"), "open")
    inner = open1.join(ends(open1, "b2"), [*LEVELS, "b2"])
    settled2 = inner.where("not ends").selectExpr("doc_id", *LEVELS, "n_tokens", "epochs + if(whole, 1, 0) as copies")
    run = f"sum(n_tokens) over (partition by {', '.join(LEVELS)} order by h, doc_id nulls first rows between unbounded preceding and current row)"
    last = inner.where("ends").selectExpr("doc_id", *LEVELS, "n_tokens", "epochs", f"before + {run} <= rest as taken")
    settled3 = last.selectExpr("doc_id", *LEVELS, "n_tokens", "epochs + if(taken, 1, 0) as copies")
    return settled.union(settled2).union(settled3).where("copies > 0")


def select(docs: DataFrame, **parameters) -> DataFrame:
    """The chosen rows of `docs`, each as often as it has copies, with the columns of `docs`."""
    *key, copies, n = common.free_names(docs, "doc", *LEVELS, "copies", "n")
    chosen = choose(docs, **parameters).selectExpr(f"doc_id as {key[0]}", *[f"{c} as {k}" for c, k in zip(LEVELS, key[1:])], f"copies as {copies}")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key[0]))
    for c, k in list(zip(LEVELS, key[1:]))[1:]:
        same = same & (name(c) == F.col(k))
    rows = docs.join(chosen, same).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return rows.select(*map(common.quoted, docs.columns))


def oracle_sql(numerator: int = 1, denominator: int = 2, max_epochs: int = 2, weights: dict | None = None, seed: str = SEED, table: str = "documents") -> str:
    """DuckDB's SQL for `choose`, with one plain window over each leaf in place of the radix."""
    weights = WEIGHTS if weights is None else weights
    case = lambda level: "case " + " ".join(f"when {level} = '{n}' then {w}" for n, w in sorted(weights.get(level, {}).items())) + " else 1 end" if weights.get(level) else "1"
    parts = [
        f"""with raw as (select doc_id, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n from {table}),
        named as (select *, 'domain' || (('0x' || substr(md5(source), 1, 4))::bigint % 4) as domain from raw),
        units as (select doc_id, domain, lang, source, sum(n)::bigint as n_tokens from named group by all),
        leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {max_epochs})::bigint as cap from units group by all),
        p0 as (select 'all' as root, least(sum(tokens)::bigint * {numerator} // {denominator}, sum(cap)::bigint) as budget from leaves)"""
    ]
    for depth in range(1, len(LEVELS) + 1):
        above, name = LEVELS[: depth - 1], LEVELS[depth - 1]
        group = ", ".join([*above, name])
        using = ", ".join(["root", *above])
        over = f"partition by {using}"
        order = f"over ({over} order by cap / w, {name} rows between unbounded preceding and 1 preceding)"
        parts.append(
            f"""n{depth} as (select 'all' as root, {group}, sum(cap)::bigint as cap, {case(name)} as w from leaves group by {group}),
        o{depth} as (select *, coalesce(sum(cap) {order}, 0)::bigint as cb, (sum(w) over ({over}) - coalesce(sum(w) {order}, 0))::bigint as wl
            from n{depth} join p{depth - 1} using ({using})),
        f{depth} as (select *, cap * wl <= w * (budget - cb) as filled from o{depth}),
        p{depth} as (select root, {group}, case when filled then cap else
            (w * (budget - sum(case when filled then cap else 0 end) over ({over}))) // greatest(sum(case when filled then 0 else w end) over ({over}), 1) end::bigint as budget
            from f{depth})"""
        )
    key = ", ".join(LEVELS)
    return (
        ",\n".join(parts)
        + f""", dealt as (select u.*, budget // tokens as epochs, budget % tokens as rest,
        ('0x' || substr(md5('{seed}:' || (budget // tokens)::varchar || ':' || coalesce(doc_id::varchar, '')), 1, {HASH_BITS // 4}))::bigint as h
        from units u join leaves using ({key}) join p{len(LEVELS)} using ({key}) where budget > 0 and tokens > 0),
        run as (select *, sum(n_tokens) over (partition by {key} order by h, doc_id rows between unbounded preceding and current row) as upto from dealt)
        select doc_id, {key}, n_tokens, (epochs + case when upto <= rest then 1 else 0 end)::bigint as copies
        from run where epochs + case when upto <= rest then 1 else 0 end > 0"""
    )
