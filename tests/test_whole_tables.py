"""Queries over tables that are larger than the smallest ones use every row."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.plans import catalog, roles
from ragloom.plans.registry import Tables

LARGE = "/root/testdata/sf0.1"


def test_dense_scores_use_every_vector(spark, tmp_path):
    n = 1_197  # a multiple of 7
    vectors = np.random.default_rng(0).normal(size=(n, 4)).astype("float32")
    embedding = F.col("embedding").cast("array<float>").alias("embedding")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").select("vec_id", embedding).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(n).selectExpr("id as doc_id", "concat('src', id % 2) as source", "'en' as lang", "'some text' as text", "9L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one"), (901, "two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.card_id): r.dense for r in roles.dense_scores(Tables(spark, str(tmp_path))).collect()}
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    used = (np.arange(n) * 8 + 3) % n
    assert len(got) == 2 * n and len(set(used.tolist())) == n
    for item in (1, 901):
        assert np.allclose([got[item, c] for c in range(n)], unit[used] @ unit[item], atol=2e-6)


def test_soft_exact_match_uses_every_item(spark, tmp_path):
    items = [(10 * i, f"alpha{i} beta{i} gamma{i} delta{i} eta{i} zeta{i} theta{i}") for i in range(90)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, "user", f"zeta{i}") for i in range(90)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = catalog.queries()["soft_exact_match"](spark, str(tmp_path)).collect()
    scored = [i for i, _ in items if not (i % 4 + i % 3 >= 3 or i % 7 >= 5)]
    assert len(out) == len(scored) > 30 and all(r.sem_b == 1 for r in out)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["soft_exact_match", "gold_mention_join"])
def test_larger_tables_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{LARGE}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.queries()[name](spark, LARGE)
    columns = sorted(df.columns)
    ours = sorted(tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect())
    theirs = con.sql(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert ours == sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in theirs)


def test_sinks(spark, tmp_path):
    from ragloom.sources import sinks

    df = spark.createDataFrame([(1, "x", True), (2, "y", False)], "id long, g string, flag boolean")
    sinks.csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    sinks.by_flag(df, "flag", f"{tmp_path}/flags")
    assert spark.read.parquet(f"{tmp_path}/flags").where("flag = 'true'").count() == 1
    sinks.groups(df, ["g"], f"{tmp_path}/groups")
    sinks.groups(df.where("g = 'x'"), ["g"], f"{tmp_path}/groups")
    assert spark.read.parquet(f"{tmp_path}/groups").count() == 2
    made = []
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/cache", {"alpha": 0.5}, lambda: (made.append(1), df)[1]).count() == 2
    assert len(made) == 1
    os.remove(f"{tmp_path}/cache/alpha=0.5/_SUCCESS")
    assert sinks.cached(spark, f"{tmp_path}/cache", {"alpha": 0.5}, lambda: df.limit(1)).count() == 1
