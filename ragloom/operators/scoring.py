"""Answer scoring and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scorable(no_answer: Column, not_applicable: Column, idk: Column, n_annotations: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ~((zero(no_answer) + zero(not_applicable) >= 3) | (zero(idk) >= 5) | (zero(n_annotations) == 0))


def golds(annotations: DataFrame, keys: list[str], local: Column) -> DataFrame:
    """Gold answers with their votes, from `annotation` as the readers give it: the English ones, and before them those in the
    question's own language where `local`. Questions that can't be scored have none; `place` is the order of trial."""
    note, idks = F.col("annotation.annotations"), F.col("annotation.idks")
    kept = annotations.where(scorable(idks["no-answer"], idks["not-applicable"], idks["idk"], F.coalesce(F.size(note), F.lit(0))))
    rows = kept.withColumn("__local", F.coalesce(local, F.lit(False))).select(*keys, "__local", F.posexplode(note).alias("__at", "__a"))
    none = F.array().cast("array<string>")
    own = F.when(F.col("__local"), F.coalesce("__a.answers", none)).otherwise(none)
    said = F.concat(own, F.coalesce("__a.en_answers", none))
    rows = rows.select(*keys, F.col("__a.count").alias("votes"), "__at", F.posexplode(said).alias("__i", "gold")).withColumn("gold", F.lower(F.trim("gold"))).where("gold <> ''")
    return rows.select(*keys, "gold", "votes", F.struct((-F.col("votes")).alias("v"), F.col("__at").alias("at"), F.col("__i").alias("i")).alias("place"))


def soft_match(response: Column, lemmas: Column, gold: Column, gold_lemmas: Column) -> Column:
    """A gold answer matches if it stands in the response, or if all its base forms are among the response's."""
    return (gold != "") & (F.contains(response, gold) | ((F.size(gold_lemmas) > 0) & F.forall(gold_lemmas, lambda w: F.array_contains(lemmas, w))))


def soft_exact_match(answers: DataFrame, golds: DataFrame, keys: list[str]) -> DataFrame:
    """SEM-B (a match or none) and SEM-W (best matched votes over most votes). `answers`: keys, response, lemmas; `golds`:
    keys, gold, gold_lemmas, votes."""
    joined = answers.join(golds, keys)
    hit = soft_match(F.col("response"), F.col("lemmas"), F.col("gold"), F.col("gold_lemmas"))
    rows = joined.groupBy(*keys).agg(F.max(hit.cast("int")).alias("sem_b"), F.max(F.when(hit, F.col("votes")).otherwise(0)).alias("v"), F.max("votes").alias("most"))
    return rows.select(*keys, "sem_b", (F.col("v") / F.col("most").cast("double")).alias("sem_w"))


def group_scores(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_scored"), F.avg(F.col(score).cast("double")).alias("mean"))


def mean_of_means(scores: DataFrame, levels: list[list[str]], score: str = "score", digits: int | None = None) -> DataFrame:
    """Averages over averages: first per levels[0], then per levels[1], and so on. With `digits`, the first are rounded."""
    out = scores.where(F.col(score).isNotNull()).groupBy(*levels[0]).agg((F.avg(F.col(score).cast("double")) * 100).alias("m"))
    if digits is not None:
        out = out.withColumn("m", F.round("m", digits))
    for keys in levels[1:]:
        out = out.groupBy(*keys).agg(F.avg("m").alias("m"))
    return out


def pivot(df: DataFrame, rows: list[str], column: str, values: list, cell: Column) -> DataFrame:
    """Columns from an explicit list of values, so no pass over the data looks for them."""
    return df.groupBy(*rows).pivot(column, values).agg(cell)


def with_subtotals(df: DataFrame, setting: str, kind: str, measures: list[str]) -> DataFrame:
    """Settings, averages of their classes, and the average of all: unweighted means of setting rows."""
    sets = df.groupingSets([[F.col(setting), F.col(kind)], [F.col(kind)], []], F.col(setting), F.col(kind))
    label = F.when(F.grouping(setting) == 0, F.col(setting)).when(F.grouping(kind) == 0, F.concat(F.lit("avg "), F.col(kind))).otherwise(F.lit("avg all"))
    return sets.agg(label.alias("row"), *[F.round(F.avg(m), 6).alias(m) for m in measures]).drop(setting, kind)


def flips(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    b, a = F.col(before), F.col(after)
    return df.groupBy(*keys).agg(F.count_if((b == 0) & (a == 1)).alias("to_right"), F.count_if((b == 1) & (a == 0)).alias("to_wrong"), F.count_if(b == a).alias("same"))


def order_by_list(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Position in a reporting order; what the order doesn't name comes last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.withColumn("position", F.when(place > 0, place).otherwise(len(order) + 1).cast("long"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Least, interpolated median, greatest."""
    return df.agg(F.min(column).alias("min"), F.percentile(column, 0.5).alias("median"), F.max(column).alias("max"))


def first_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A fixed sample of n ids without replacement: the n first by a seeded hash."""
    return df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def running_rank(group: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))
