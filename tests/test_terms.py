"""Terms taken apart and counted within tasks, against the column expressions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.functions import models, text
from ragloom.operators import retrieval

ODD = [None, "", " ", "the", "The cat, THE  cat; a_b a-b", "ÄÖÜ straße ΟΔΟΣ İstanbul", "été 日本語、中文 １２ ٣٤ x² Ⅷ", "a b　c d\x00e\tf\x1fg", "😀x😀", "«quoted»—dash…", "of " * 40 + "end", "y" * 3000]


def test_split_terms_are_the_index_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    made = rows.select("i", F.lower("t").alias("low"), text.index_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    lowered = pa.array([r.low for r in made], pa.string())
    for part, first in ((lowered, 0), (lowered.slice(4, 3), 4), (lowered.slice(0, 1), 0), (lowered.slice(0, 0), 0)):
        words, own = text.split_terms(part)
        found = [[] for _ in part]
        for w, i in zip(words.to_pylist(), own.tolist()):
            found[i].append(w)
        assert found == [r.w for r in made[first : first + len(part)]]


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_counts_are_the_same_in_blocks_of_any_size(spark, block):
    cards = [("hot" if i % 7 else "cold", i, ODD[i % len(ODD)]) for i in range(120)] + [(None, 900, "lost"), ("bare", 901, None)]
    df = spark.createDataFrame(cards, "country string, card_id long, text_en string")
    tokens = F.array_distinct(text.index_tokens(F.col("text_en")))
    size = F.array(F.concat(F.lit(" "), F.size(text.index_tokens(F.col("text_en"))).cast("string")))
    plain = df.where("country is not null").select("country", F.explode(F.concat(tokens, size)).alias("term")).groupBy("country", "term").count()
    found = retrieval.term_counts(df, block=block)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_a_term_leaves_a_block_once_and_texts_are_read_once(spark):
    cards = spark.range(400).selectExpr("concat('c', id % 2) as country", "id as card_id", "concat('same words here ', id % 3) as text_en")
    plan = retrieval.term_counts(cards)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    asked = spark.createDataFrame([("c0", 1, "same words"), ("c1", 2, "here the 2")], "country string, item_id long, question string")
    weights = retrieval.counted_weights(retrieval.term_counts(cards), asked, "country", "item_id", "question", 0.25)
    assert weights.count() == 4
    weights = retrieval.counted_weights(retrieval.term_counts(cards), asked, "country", "item_id", "question", 0.25)
    weights.collect()
    final = weights._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 2 and "ReusedExchange" in final  # one of the questions, one of the cards


def test_reranker_makes_no_union(spark):
    sets = [(["a", "b"], ["b", "c"]), ([], []), (["a"], []), ([], ["a"]), (["a", "b", "c"], ["c", "b", "a"])]
    df = spark.createDataFrame(sets, "q array<string>, c array<string>").select("q", "c", models.lexical_reranker(F.col("q"), F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == [1 / 3, 0.0, 0.0, 0.0, 1.0]
    assert "array_union" not in df._jdf.queryExecution().optimizedPlan().toString()
