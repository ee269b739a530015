"""Audits of a knowledge base: recomputed profiles, shares, rules and near-duplicate prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def shortfall(cards: DataFrame, categories: DataFrame, category: str, target: int) -> DataFrame:
    """Cards per category, also of empty ones, and what is missing to the target."""
    n = cards.groupBy(category).agg(F.count("*").alias("n"))
    joined = categories.join(n, category, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("shortfall", F.greatest(F.lit(target) - F.col("n"), F.lit(0)))


def shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per metric and value, as a tall table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.metric", "x.value").agg(F.count("*").alias("n"))


def multi_valued(df: DataFrame, column: str, separator: str = r";\s*") -> DataFrame:
    return df.select(F.explode(F.split(column, separator)).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def rules(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per rule from one-row tables with a boolean `ok`."""
    out = None
    for name, table in checks.items():
        row = table.select(F.lit(name).alias("rule"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"))
        out = row if out is None else out.union(row)
    return out


def prefix_duplicates(df: DataFrame, body: str, key: str, k: int = 80) -> DataFrame:
    """Groups of texts that share the first k characters of their normal form."""
    p = F.substring(text.normalize(F.col(body)), 1, k)
    return df.select(p.alias("prefix"), key).groupBy("prefix").agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")
