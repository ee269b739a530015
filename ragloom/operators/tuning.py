"""Grid evaluation and choice of retrieval parameters on development partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import scores

from . import retrieval


def recall_at(top: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the questions of `hits` (keys: those with a gold card) with a gold card among `top` (keys.., card_id)."""
    found = top.join(hits, [*keys, "card_id"], "left_semi").select(*keys).distinct().withColumn("hit", F.lit(1.0))
    asked = top.select(*keys).distinct()
    return asked.join(found, keys, "left").select(*keys, F.coalesce("hit", F.lit(0.0)).alias("hit"))


def f_by_threshold(ranked: DataFrame, thresholds: DataFrame, keys: list[str], k: int = 3, beta: float = 0.5) -> DataFrame:
    """tp and fp count cards sent, fn counts questions that have a gold card among the candidates but none sent.

    `ranked`: keys, card_id, rerank, rank, gold (boolean). Each pair is labelled once and meets every threshold once."""
    per = ranked.crossJoin(F.broadcast(thresholds)).withColumn("sent", (F.col("rank") <= k) & (F.col("rerank") >= F.col("tau")))
    one = per.groupBy("pos", "tau", *keys).agg(
        F.count_if(F.col("sent") & F.col("gold")).alias("tp"), F.count_if(F.col("sent") & ~F.col("gold")).alias("fp"), F.bool_or("gold").alias("any_gold")
    )
    total = one.groupBy("pos", "tau").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count_if(F.col("any_gold") & (F.col("tp") == 0)).alias("fn"))
    return total.select("pos", "tau", "tp", "fp", "fn", F.round(scores.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta), 6).alias("f"))


def first_best(table: DataFrame, value: str, metric: str, position: str = "pos") -> DataFrame:
    """The grid value with the best metric, of equals the first."""
    return table.agg(F.max_by(value, F.struct(F.col(metric), -F.col(position))).alias(value), F.max(metric).alias(metric))


def alphas(graded: DataFrame, hits: DataFrame, values: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """Recall at k by fusion weight (pos, alpha, recall)."""
    fused = retrieval.hybrid(graded.crossJoin(F.broadcast(values)), F.col("alpha"))
    top = retrieval.top_k(fused, k, ["pos", "alpha", *keys], "hybrid").select("pos", "alpha", *keys, "card_id")
    found = top.join(hits, [*keys, "card_id"], "left").groupBy("pos", "alpha", *keys).agg(F.max(F.when(F.col("gold"), 1.0).otherwise(0.0)).alias("hit"))
    return found.groupBy("pos", "alpha").agg(F.round(F.avg("hit"), 6).alias("recall"))
