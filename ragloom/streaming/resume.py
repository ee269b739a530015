"""Resumable job processing as a stream of files: each micro-batch answers the jobs that have no answer yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ragloom.sources.ledger import Ledger


def answer_stream(spark: SparkSession, jobs: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "job_id") -> StreamingQuery:
    """Runs over the files now in `jobs` and stops; `Ledger(spark, out).read()` has the answers. A batch is committed under its
    stream's checkpoint and number, so one that is tried again after its commit adds nothing."""
    stream = spark.readStream.schema(schema).json(jobs)

    def batch(df: DataFrame, number: int) -> None:
        Ledger(df.sparkSession, out).append(df, [key], work, f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
