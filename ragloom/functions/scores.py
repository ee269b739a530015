"""Numeric functions: vectors, normalisation, fusion, F-measure, and keys that make ties definite."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def minmax(score: Column, *group: str) -> Column:
    """To 0..1 within a group; 0 where a group is constant."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.0))


def fuse(dense: Column, lexical: Column, alpha: float | Column) -> Column:
    a = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    return a * dense + (F.lit(1.0) - a) * lexical


def sigmoid_if_logits(score: Column, *group: str) -> Column:
    """The logistic function, but only in groups that have a score outside 0..1."""
    w = Window.partitionBy(*group)
    logits = (F.min(score).over(w) < 0) | (F.max(score).over(w) > 1)
    return F.when(logits, 1 / (1 + F.exp(-score))).otherwise(score)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    """0 where it is not defined."""
    tp, fp, fn = (c.cast("double") for c in (tp, fp, fn))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    b = beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(F.lit(0.0))


def rank_within(group: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def missing(score: Column) -> Column:
    """NaN to null; Spark has NaN above all numbers, and averages keep it."""
    return F.when(F.isnan(score), F.lit(None)).otherwise(score)


def p_yes(token_logprobs: Column, response: Column) -> Column:
    """P(YES) / (P(YES) + P(NO)) of the first token's alternatives, or whether the response says yes if there are none."""
    lps = F.coalesce(token_logprobs, F.array().cast("array<struct<token:string,logprob:double>>"))

    def mass(word: str) -> Column:
        hits = F.filter(lps, lambda t: F.startswith(F.upper(F.trim(t["token"])), F.lit(word)))
        return F.aggregate(hits, F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))

    yes, no = mass("YES"), mass("NO")
    said = F.startswith(F.upper(F.trim(F.coalesce(response, F.lit("")))), F.lit("YES"))
    return F.when(yes + no > 0, yes / (yes + no)).otherwise(F.when(said, F.lit(1.0)).otherwise(F.lit(0.0)))


def p_yes_source(token_logprobs: Column) -> Column:
    """`logprobs` where an alternative says yes or no, `text` where only the response can tell."""
    lps = F.coalesce(token_logprobs, F.array().cast("array<struct<token:string,logprob:double>>"))
    said = F.exists(lps, lambda t: F.upper(F.trim(t["token"])).rlike("^(YES|NO)"))
    return F.when(said, "logprobs").otherwise("text")
