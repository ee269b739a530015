"""Writers: JSON lines, delimited files, side outputs, pending groups and keyed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line with its null fields; characters stay as they are."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def by_flag(df: DataFrame, flag: str, path: str) -> None:
    """One pass, two outputs: rows with and without the flag."""
    df.write.mode("overwrite").partitionBy(flag).parquet(path)


def groups(df: DataFrame, keys: list[str], path: str) -> None:
    """One partition per group; groups that are there and not in `df` stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def append_missing(df: DataFrame, spark: SparkSession, path: str, key: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Run `work` on the rows whose key the output lacks, and append what it makes; returns how many rows were missing."""
    todo = pending(df, spark.read.parquet(path), key) if exists(spark, path) else df
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    return n


def cached(spark: SparkSession, path: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under a path that spells its parameters out."""
    at = f"{path}/" + "/".join(f"{k}={v}" for k, v in sorted(key.items()))
    if not exists(spark, f"{at}/_SUCCESS"):  # a half-written folder is no finished one
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def json_record(*columns: str) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def report(df: DataFrame, order: str, line: str, path: str) -> None:
    """A text file of lines in order. Reports are short: one task writes all of it."""
    df.repartition(1).sortWithinPartitions(order).select(line).write.mode("overwrite").text(path)


def observed(df: DataFrame, name: str, **counts: F.Column) -> tuple[DataFrame, Observation]:
    """`df`, and the number of its rows (and of other aggregates) as the next action on it sees them; no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]), seen
