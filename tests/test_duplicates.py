"""Canonical addresses, and classes by several rules."""

import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import duplicates


@pytest.mark.parametrize(
    "given, out",
    [
        ("HTTP://Example.COM:80", "http://example.com/"), ("https://example.com:443/a?b=2&a=1#x", "https://example.com/a?a=1&b=2"), ("http://e.com:8080/A%7eb%2f%c3", "http://e.com:8080/A~b%2F%C3"),
        ("http://e.com/?&&", "http://e.com/"), ("http://e.com/100%", "http://e.com/100%"), ("http://e.com/%zz?q=%41", "http://e.com/%zz?q=A"), ("https://e.com:80/", "https://e.com:80/"), ("ftp://e.com:/x", "ftp://e.com/x"),
        ("no address", None), ("", None), (None, None),
    ],
)
def test_canonical_url(spark, given, out):
    df = spark.createDataFrame([(given,)], "url string")
    assert df.select(duplicates.canonical_url(F.col("url")).alias("u")).first().u == out


def test_classes_against_union_find(spark):
    rng = random.Random(3)
    rows = [(i, f"u{i}" if i % 3 else None, f"p{i // 2}", f"t{(i + 1) // 2}" if i < 40 else None) for i in range(60)]  # one chain of 40 by two rules, pairs beyond
    rows += [(i, "hot", None, f"z{i}") for i in range(100, 160)] + [(i, f"x{rng.randrange(60)}", None, f"y{rng.randrange(60)}") for i in range(200, 260)] + [(300, None, None, None), (None, "hot", None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, *values in rows:
        for at, v in enumerate(values):
            if v is not None and i is not None:
                a, b = sorted((root(i), root(first.setdefault((at, v), i))))
                parent[b] = a
    out = {r.id: r.class_id for r in duplicates.classes(df, "id", {n: F.col(n) for n in "abc"}).collect()}
    assert out == {i: root(i) for i in parent}
    assert duplicates.classes(df.where("false"), "id", {"a": F.col("a")}).count() == 0
