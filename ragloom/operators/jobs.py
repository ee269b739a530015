"""Prompt jobs: settings x prompts x questions, filled templates, context, resumption, and answers routed by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text


def enumerate_jobs(settings: DataFrame, prompts: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question of a setting's country under every prompt. Settings and prompts are configuration: some rows each."""
    plan = settings.crossJoin(F.broadcast(prompts))
    jobs = questions.join(F.broadcast(plan), "country")
    return jobs.withColumn("job_id", text.composite_key(F.col("country"), F.col("language"), F.col("prompt_no"), F.col("qid")))


def question_text(language: Column, local_language: Column, q_local: Column, q_en: Column) -> Column:
    return F.when(language == local_language, q_local).otherwise(q_en)


def prompts(jobs: DataFrame, template: str, question: str, cards: str | None = None, version: str = "v1") -> DataFrame:
    body = text.fill(F.col(template), "q", F.col(question))
    if cards is not None:
        body = F.concat(text.context_block(F.col("country"), F.col(cards), version), body)
    return jobs.withColumn("prompt", body)


def side_output(jobs: DataFrame, has_cards: Column) -> tuple[DataFrame, DataFrame]:
    return jobs, jobs.where(has_cards)


def unfinished(jobs: DataFrame, answers: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.join(answers.select(key), key, "left_anti")


def strict(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that fails if a key of `left` has no match."""
    marked = right.withColumn("__there", F.lit(True))
    joined = left.join(marked, keys, "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
    return joined.withColumn("__there", there.otherwise(F.lit(True))).where("__there").drop("__there")


def lenient(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    joined = left.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def gated_merge(jobs: DataFrame, with_cards: DataFrame, rag: DataFrame, base: DataFrame, key: str = "job_id", value: str = "response") -> DataFrame:
    """Each job's answer: the second system's where the job had cards, the first's otherwise; `source` says which. Missing
    answers are null here; `missing` lists them."""
    flags = with_cards.select(key).distinct().withColumn("has_cards", F.lit(True))
    merged = jobs.join(flags, key, "left").join(rag.select(key, F.col(value).alias("__rag")), key, "left").join(base.select(key, F.col(value).alias("__base")), key, "left")
    routed = F.coalesce("has_cards", F.lit(False))
    return merged.select(
        *jobs.columns, F.when(routed, F.col("__rag")).otherwise(F.col("__base")).alias(value), F.when(routed, "rag").otherwise("baseline").alias("source")
    )


def missing(merged: DataFrame, value: str = "response") -> DataFrame:
    return merged.where(F.col(value).isNull())


def integrity(rows: DataFrame, ids: Column, known: DataFrame, key: str) -> DataFrame:
    """References of an id array that `known` lacks."""
    return rows.select("*", F.explode(ids).alias(key)).join(known.select(key), key, "left_anti")


def divide(rows: DataFrame, group: str, member: str, ok, divisor: DataFrame) -> DataFrame:
    """Relational division: per group how many of the divisor's distinct members it has with `ok`, and whether it has every one. A group
    without any is left out; members outside of the divisor and null ones don't count; nothing is divided by an empty divisor."""
    wanted = divisor.select(member).where(F.col(member).isNotNull()).distinct()
    has = rows.where(ok).select(group, member).distinct().join(wanted, member, "left_semi").groupBy(group).agg(F.count("*").alias("has"))
    total = wanted.agg(F.count("*").alias("wanted"))
    return has.crossJoin(F.broadcast(total)).withColumn("every", F.col("has") == F.col("wanted"))
