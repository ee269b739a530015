"""Which texts mention which phrases as whole words: phrases of any length, with any marks inside.

The distinct phrases go in passes of about `PASS` characters, by their hash; a pass is one automaton, built in the tasks, that finds all of its
phrases in one reading of a text. So no phrase meets every text, texts aren't shuffled, and what is broadcast has a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the phrases of one pass; the longest phrase may come on top.
PASS = 1_000_000


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a word begins or ends on both sides of text[start:end]."""
    before = (start > 0 and _is_word(text[start - 1])) != _is_word(text[start])
    return before and (end < len(text) and _is_word(text[end])) != _is_word(text[end - 1])


def _found(texts: DataFrame, keys: list[str], body: str, phrases: list[str], out: str) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(phrases)
    schema = T.StructType([*[texts.schema[k] for k in keys], T.StructField(out, T.StringType())])

    def run(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for p in held.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                own = {p for end, p in automaton.iter(text or "") if _bounded(text, end + 1 - len(p), end + 1)}
                rows += [i] * len(own)
                hits += own
            taken = b.take(pa.array(np.array(rows, "int64")))
            yield pa.RecordBatch.from_arrays([*taken.columns[: len(keys)], pa.array(hits, pa.string())], [*keys, out])

    return texts.select(*keys, F.lower(body).alias("__body")).mapInArrow(run, schema)


def mentions(texts: DataFrame, phrases: DataFrame, keys: list[str], body: str, phrase: str = "gold", size: int = PASS) -> DataFrame:
    """`phrases` (phrase, other columns) with the texts (keys) that mention them: lower case on both sides, and a word's boundary at both
    ends. Blanks around a phrase don't count; a null or empty one, or a null text, mentions nothing. A text's repeats count once.

    Jobs run while the plan is built: one for the phrases' size and one per pass. A pass reads the texts again."""
    clean = F.lower(F.trim(F.col(phrase)))
    known = phrases.select(clean.alias("__p")).where("__p <> ''").distinct()
    total = known.agg(F.sum(F.length("__p")).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // size))
    lists = [[r["__p"] for r in known.where(F.pmod(F.xxhash64("__p"), F.lit(passes)) == i).collect()] for i in range(passes)]
    parts = [_found(texts, keys, body, p, "__p") for p in lists if p]
    if not parts:
        return texts.select(*keys).join(phrases, F.lit(False))
    return reduce(DataFrame.unionByName, parts).join(phrases.withColumn("__p", clean), "__p").drop("__p")
