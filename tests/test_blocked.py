"""Blocked scoring against whole grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import blocked, retrieval

ALPHAS = [0.0, 0.1, 0.5, 0.9, 1.0]


def brute_band(a, b, k):
    return [i for i in range(len(a)) if sum(a[j] >= a[i] and b[j] >= b[i] for j in range(i)) < k]


@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("values", [2, 7, 1000])
def test_skyband_and_best_against_all_pairs(k, values):
    rng = np.random.default_rng(k * values)
    for n in (0, 1, 63, 64, 65, 300):
        a, b = rng.integers(0, values, n) / 10, rng.integers(0, values, n) / 10 * (rng.random(n) < 0.3)
        band = blocked.skyband(a, b, k).tolist()
        assert band == brute_band(a, b, k)
        top = sorted(range(n), key=lambda i: (-a[i], i))[:k]
        assert set(blocked.best(a, k).tolist()) == set(top)
        for w in ALPHAS:
            fused = np.round(w * a + (1 - w) * b, 6)
            assert set(sorted(range(n), key=lambda i: (-fused[i], i))[:k]) <= set(band)


@pytest.fixture(scope="module")
def world(spark):
    """A region with nine tenths of the cards, ties, cards without text and without a vector, a question that shares no word."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    cards = []
    for i in range(400):
        body = " ".join(rng.choice(words, rng.integers(0, 12))) if i % 17 else None
        vector = None if i == 5 else [float(x) for x in rng.integers(-2, 3, 3)]
        cards.append(("hot" if i % 10 else "cold", i, body, vector))
    asked = [(part, q, " ".join(rng.choice(words, 4)) if q else "sky", [float(x) for x in rng.integers(-2, 3, 3)]) for part in ("hot", "cold", "none") for q in range(9)]
    c = spark.createDataFrame(cards, "country string, card_id long, text_en string, v array<float>")
    return c, spark.createDataFrame(asked, "country string, item_id long, question string, v array<float>")


def whole(cards, questions):
    """Every pair, by the joins on the region."""
    dense = retrieval.dense(questions, cards.where("v is not null"), "country", "item_id", "card_id", "v", "v")
    return retrieval.normalised(dense.join(retrieval.bm25(cards, questions), ["country", "item_id", "card_id"]), ["country", "item_id"])


def joined(cards, questions):
    q, c = blocked.with_terms(cards, questions)
    return questions.join(q, ["country", "item_id"]), cards.join(c, ["country", "card_id"])


@pytest.mark.parametrize("block", [16, 2048])
def test_top_k_at_any_weight_is_that_of_the_grid(spark, world, block):
    grid = {}
    for r in whole(*world).collect():
        grid.setdefault((r.country, r.item_id), []).append(r)
    q, c = joined(*world)
    band = {}
    for r in blocked.graded(blocked.scored(q, c, 5, vector="v", block=block)).collect():
        band.setdefault((r.country, r.item_id), []).append(r)
    assert set(grid) == set(band) and {part for part, _ in band} == {"hot", "cold"}
    for key, rows in grid.items():
        kept = band[key]
        assert {r.max_dense for r in kept} == {max(r.dense for r in rows)} and {r.max_bm25 for r in kept} == {max(r.bm25 for r in rows)}
        forms = {r.card_id: (r.dense, r.bm25, r.dn, r.ln) for r in rows}
        assert all(np.allclose(forms[r.card_id], (r.dense, r.bm25, r.dn, r.ln), atol=1e-12) for r in kept)
        for w in ALPHAS:
            top = lambda rs: [r.card_id for r in sorted(rs, key=lambda r: (-round(w * r.dn + (1 - w) * r.ln, 6), r.card_id))[:5]]  # noqa: B023, E731
            assert top(rows) == top(kept)


def test_hot_partition_is_many_blocks(spark, world):
    cards, questions = world
    same = cards.select("country", F.col("card_id").alias("item_id"), "v")
    near = blocked.scored(same, cards, 3, vector="v", terms=None, others=True, block=32)
    top = {}
    for r in retrieval.top_k(near, 3, ["country", "item_id"], "dense").collect():
        assert r.card_id != r.item_id
        top.setdefault(r.item_id, []).append((r["rank"], r.card_id))
    rows = [r for r in cards.collect() if r.v is not None]
    unit = {r.card_id: np.array(r.v) / (np.linalg.norm(r.v) or 1.0) for r in rows}
    for r in rows:
        others = [o.card_id for o in rows if o.country == r.country and o.card_id != r.card_id]
        best = sorted(others, key=lambda i: (-round(float(unit[i] @ unit[r.card_id]), 6) + 0.0, i))[:3]
        assert [i for _, i in sorted(top[r.card_id])] == best
    sizes = cards.groupBy("country").agg(F.ceil(F.count("*") / 32).alias("__n_c"), F.lit(1).cast("long").alias("__n_q"))
    dealt = blocked._dealt(cards, "card_id", "c", "q", sizes, "country").groupBy("country", "__c").count().collect()
    assert len(dealt) > 12 and max(r["count"] for r in dealt) <= 2 * sorted(r["count"] for r in dealt)[len(dealt) // 2]


def test_empty_tables_and_vectors_of_two_lengths(spark, world):
    q, c = joined(*world)
    for a, b in ((q.where("false"), c), (q, c.where("false"))):
        assert blocked.scored(a, b, 3, vector="v").count() == 0
    two = c.withColumn("v", F.when(F.col("card_id") % 2 == 0, F.slice("v", 1, 2)).otherwise(F.col("v")))
    assert {r.card_id % 2 for r in blocked.scored(q, two, 3, vector="v").select("card_id").collect()} == {1}


@pytest.mark.parametrize("rule", ["dense", "bm25"])
def test_questions_beyond_the_bound_meet_dealt_cards(spark, world, rule):
    cards, questions = world
    score = {
        "dense": lambda **more: retrieval.dense(questions, cards.where("v is not null"), "country", "item_id", "card_id", "v", "v", **more),
        "bm25": lambda **more: retrieval.bm25(cards, questions, **more),
    }[rule]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(score(limit=0)) == rows(score())


def test_a_hot_region_is_dealt(spark, world):
    cards, questions = world
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = retrieval.meet(cards.select("country", "card_id"), questions.select("country", "item_id"), ["country"], "card_id", limit=0)
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
        held = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(held) == 400 * 9 and max(held) <= 0.5 * sum(held)


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([("ab", [1.0] * 100, {"k": "v"}), (None, None, None)], "s string, v array<double>, m map<string, string>")
    wide, bare = sorted((r[0] for r in df.select(retrieval.row_bytes(df)).collect()), reverse=True)
    assert bare == 32 + 3 * 16 + 8 * len("{}") and wide >= bare + 2 + 800 + 8 * len('{"k":"v"}')
    assert retrieval.fits(df, wide + bare) and not retrieval.fits(df, wide + bare - 1) and not retrieval.fits(df, wide + bare, more=1)
    assert retrieval.fits(df.limit(0), 0)


@pytest.mark.parametrize("block", [16, 1024])
def test_grid_of_blocks_is_the_whole_grid(spark, world, block):
    q, c = joined(*world)
    rows = lambda df: {(r.country, r.item_id, r.card_id): (r.dense, r.bm25) for r in df.select("country", "item_id", "card_id", "dense", "bm25").collect()}
    met, every = rows(blocked.grid(q, c, vector="v", block=block)), rows(whole(*world))
    assert set(met) == set(every) and all(np.allclose(met[k], every[k], atol=2e-6) for k in every)
    ends = {(r.country, r.item_id): (r.d0, r.max_dense, r.l0, r.max_bm25) for r in blocked.extremes(blocked.scored(q, c, 0, vector="v", block=block)).collect()}
    for key, found in ends.items():
        own = np.array([v for (a, b, _), v in every.items() if (a, b) == key])
        assert np.allclose(found, (*[f(own[:, 0]) for f in (np.min, np.max)], *[f(own[:, 1]) for f in (np.min, np.max)]), atol=2e-6)
    alone = blocked.grid(*blocked.with_terms(*world), vector=None, block=block)
    bm25 = {(r.country, r.item_id, r.card_id): r.bm25 for r in retrieval.bm25(*world).collect()}
    assert {(r.country, r.item_id, r.card_id) for r in alone.collect()} == set(bm25)
    assert "Window" not in alone._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [16, 2048])
def test_ranks_of_chosen_cards_count_all_cards(spark, world, block):
    q, c = joined(*world)
    every = retrieval.reciprocal_rank_fusion(blocked.grid(q, c, vector="v"), ["country", "item_id"])
    chosen = blocked.narrowed(blocked.scored(q, c, 3, vector="v", block=block), 3)
    few = retrieval.fused_ranks(blocked.ranked(q, c, chosen, vector="v", block=block))
    top = lambda df: sorted(map(tuple, retrieval.top_k(df, 3, ["country", "item_id"], "rrf").select("country", "item_id", "card_id", "rd", "rl", "rrf", "rank").collect()))
    assert top(few) == top(every)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_what_is_left_out_is_never_on_top_whatever_the_ids(k):
    """Better cards come last, where the skyband, which counts smaller ids only, keeps all."""
    rng = np.random.default_rng(k)
    gap = blocked.APART
    for n in (0, 1, k, k + 1, 700):
        for a, b in ((np.arange(n) / 1e3, np.arange(n) / 70), (np.round(rng.random(n), 6), np.round(10 * rng.random(n), 6)), (np.zeros(n), np.arange(n) / 1e6), (rng.integers(0, 4, n) * 1e-6, rng.integers(0, 4, n) * 1e-6)):
            left = blocked.hopeful(a, b, k, gap * 2, gap * 11)
            assert left.tolist() == sorted(set(left.tolist()))
            for w in ALPHAS:
                fused = np.round(w * a / 2 + (1 - w) * b / 11, 6)
                assert set(sorted(range(n), key=lambda i: (-fused[i], i))[:k]) <= set(left.tolist())
    rising = np.arange(2000) / 2000
    assert len(blocked.skyband(rising, rising, k)) == 2000 and len(blocked.hopeful(rising, rising, k, gap, gap)) <= 16 * (k + 1)


@pytest.mark.parametrize("block", [64, 2048])
def test_fused_scores_need_fewer_rows_for_the_same_top(spark, world, block):
    q, c = joined(*world)
    tops, rows = [], []
    for fused in (False, True):
        graded = blocked.graded(blocked.scored(q, c, 2, vector="v", block=block, fused=fused)).cache()
        rows.append(graded.count())
        tops.append([sorted(map(tuple, retrieval.top_k(retrieval.hybrid(graded, w), 2, ["country", "item_id"], "hybrid").drop("dn", "ln").collect())) for w in ALPHAS])
    assert tops[0] == tops[1] and rows[1] < rows[0]


def test_one_pass_counts_terms_and_lengths(spark, world):
    cards, _ = world
    odd = spark.createDataFrame([(None, 900, "w1 w2", None), ("bare", 901, None, None), ("bare", 902, "the of", None)], cards.schema)
    cards = cards.unionByName(odd)
    found = {r.country: r for r in retrieval.corpora(retrieval.term_counts(cards)).collect()}
    own = {}
    for r in cards.collect():
        if r.country is not None:
            own.setdefault(r.country, []).append([w for w in (r.text_en or "").split() if w not in ("the", "of")])
    assert set(found) == set(own) == {"hot", "cold", "bare"}
    for part, lists in own.items():
        n, dfs = len(lists), [sum(w in x for x in lists) for w in {w for x in lists for w in x}]
        raws = [np.log(n - d + 0.5) - np.log(d + 0.5) for d in dfs]
        assert found[part].n_cards == n and found[part].avgdl == pytest.approx(sum(map(len, lists)) / n)
        assert found[part].mean == (pytest.approx(np.mean(raws)) if raws else None)
