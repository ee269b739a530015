"""Mentions of phrases with marks, against regular expressions."""

import re

from pyspark.sql import functions as F

from ragloom.operators.mentions import mentions

TEXTS = [
    "On St. Patrick's day, hot-dog stands.", "st. patrick's days", "hot dog", "teapot and tea", "TEA", "a C++ (new) tea; c++x", "ጤፍ እና ጤፍ", "추러스를", "추러스 ok", "", None,
    "one two three four five six", "one two three four  five", "tea" * 30_000 + " tea", "x" * 200_000, "a.b axb", "İstanbul straße",
]
GOLDS = ["St. Patrick's day", "hot-dog", "tea", " Tea ", "c++", "(new)", "ጤፍ", "추러스", "one two three four five", "five", "a.b", "straße", "", None, "  ", "hot dog", "dog stands."]


def test_against_regular_expressions(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "card_id long, body string")
    golds = spark.createDataFrame(list(enumerate(GOLDS)), "item_id long, gold string")
    expected = {
        (i, n) for n, g in enumerate(GOLDS) if g and g.strip() for i, t in enumerate(TEXTS) if t and re.search(r"\b" + re.escape(g.strip().lower()) + r"\b", t.lower())
    }
    for size in (1_000_000, 12):  # one pass and several
        found = [(r.card_id, r.item_id) for r in mentions(texts, golds, ["card_id"], "body", size=size).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    assert {(0, 0), (0, 1), (4, 2), (4, 3), (11, 8)} <= expected and (1, 0) not in expected and (3, 9) not in expected


def test_repeated_keys_and_empty_tables(spark):
    texts = spark.createDataFrame([(1, "tea tea"), (1, "tea")], "card_id long, body string")
    golds = spark.createDataFrame([("tea", "x")], "gold string, body string")
    assert mentions(texts, golds, ["card_id"], "body").count() == 2  # one per text
    for a, b in ((texts, golds.where("false")), (texts.where("false"), golds), (texts, golds.withColumn("gold", F.lit("")))):
        out = mentions(a, b, ["card_id"], "body")
        assert out.count() == 0 and out.columns == ["card_id", "gold", "body"]
