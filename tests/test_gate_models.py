"""Cross-fitting against plain numpy on the driver: fold packing, every model's coefficients, what a split may see, the choice of thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import boosting, crossfit, gate


def data(spark, n=360, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.normal(), rng.normal() * 40 + 900, "xyz"[rng.integers(3)]
        help_ = None if rng.random() < 0.1 else float(a + (c == "y") + rng.normal() > 0.3)
        rows.append((i, int(rng.integers(24)), ["es", "kr", None][int(rng.integers(3))], float(a), None if rng.random() < 0.05 else float(b), c, help_))
    return rows, spark.createDataFrame(rows, "id int, template int, country string, a double, b double, c string, help double")


def solve(x, y, numbers, strength=1.0):
    """Coefficients in units of the rows' deviation, and the intercept, by gradient-checked Newton steps on one machine."""
    mean, dev = np.nanmean(x, 0), np.nanstd(x, 0)
    mean[numbers:], dev[numbers:] = 0, 1
    z = np.column_stack([np.nan_to_num((x - mean) / dev), np.ones(len(x))])
    sw = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0) / strength
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z.T * (sw * p * (1 - p))) @ z + np.diag(ridge + 1e-12), z.T @ (sw * (p - y)) + ridge * w)
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (sw * (p - y)) + ridge * w).max() < 1e-8
    return w, lambda t: 1 / (1 + np.exp(-(np.column_stack([np.nan_to_num((t - mean) / dev), np.ones(len(t))]) @ w)))


def wide(rows):
    x = np.array([[r[3], np.nan if r[4] is None else r[4], *(float(r[5] == v) for v in "xyz")] for r in rows])
    return x, np.array([np.nan if r[6] is None else r[6] for r in rows])


def test_folds_are_those_of_greedy_packing(spark):
    rng = np.random.default_rng(1)
    counts = {int(g): int(n) for g, n in enumerate(rng.integers(1, 60, size=70))}
    df = spark.createDataFrame([(g,) for g, n in counts.items() for _ in range(n)] + [(None,)] * 7, "g int")
    counts[None] = 7

    def greedy():
        load, out = [0] * 4, {}
        for g in sorted(counts, key=lambda g: (-counts[g], g is not None, g)):
            out[g] = int(np.argmin(load))
            load[out[g]] += counts[g]
        return out, load

    want, load = greedy()
    assert {r.g: r.fold for r in gate.balanced_folds(df, "g", 4).collect()} == want
    few = {r.g: r.fold for r in gate.balanced_folds(df, "g", 4, largest=9).collect()}
    held = [sum(counts[g] for g, f in few.items() if f == k) for k in range(4)]
    biggest = sorted(counts.values())[-10]
    assert few.keys() == counts.keys() and all(abs(a - b) <= biggest for a, b in zip(sorted(held), sorted(load)))
    assert gate.balanced_folds(df.where("false"), "g", 4).count() == 0


@pytest.mark.parametrize("part", [None, "country"])
def test_splits_see_neither_group_nor_part(spark, part):
    rows, df = data(spark)
    out, splits = crossfit.assign(df, 4, 3, part, "help")
    found = out.collect()
    assert len(found) == len(rows) and splits.count == (12 if part else 4)
    fold = {r.template: r.fold for r in found}
    for r in found:
        for s, j in enumerate(r.inners):
            k, c = (s // 3, splits.parts[s % 3]) if part else (s, None)
            trains = r.help is not None and k != r.fold and not (part and c == r.country)
            assert (j >= 0) == trains
        assert r.split == (r.fold * 3 + splits.parts.index(r.country) if part else r.fold)
    for s in range(splits.count):  # a group is in one inner fold
        inner = {(r.template, r.inners[s]) for r in found if r.inners[s] >= 0}
        assert len(inner) == len({t for t, _ in inner}) and {j for _, j in inner} == {0, 1, 2}
    assert len(set(fold.values())) == 4


@pytest.mark.parametrize("part", [None, "country"])
def test_every_model_is_the_plain_solver_s(spark, part):
    rows, df = data(spark)
    made, names, numbers = crossfit.design(df, ["a", "b"], ["c"])
    made, splits = crossfit.assign(made, 4, 3, part, "help")
    made = made.withColumn("y", F.col("help")).persist()
    found = {r.id: r for r in made.collect()}
    fitted = crossfit.Linear().fit(made, list(range(splits.models)), 3, numbers)
    x, y = wide(rows)
    assert names == ["a", "b", "c=x", "c=y", "c=z"] and len(fitted.weights) == splits.models == (48 if part else 16)
    for m in range(splits.models):
        on = np.array([found[r[0]].inners[m // 4] not in (-1, m % 4) for r in rows])
        assert np.allclose(fitted.weights[m], solve(x[on], y[on], 2)[0], atol=1e-6), m
    weights = fitted.coefficients(3, names)
    assert [w for _, w in weights] == sorted(w for _, w in weights) and dict(weights)["a"] > 0 and {n for n, _ in weights} == set(names)
    made.unpersist()


def test_cross_fit_scores_and_thresholds(spark):
    rows, df = data(spark, seed=5)
    out = {r.id: r for r in crossfit.cross_fit(df, ["a", "b"], ["c"], folds=4).collect()}
    made, splits = crossfit.assign(df, 4, 3, None, "help")
    found = {r.id: r for r in made.collect()}
    x, y = wide(rows)
    inners, split = np.array([found[r[0]].inners for r in rows]), np.array([found[r[0]].split for r in rows])
    assert len(out) == len(rows)
    for s in range(4):
        on = inners[:, s] >= 0
        p, oof = solve(x[on], y[on], 2)[1](x[split == s]), np.zeros(len(rows))
        ids = [r[0] for r, held in zip(rows, split == s) if held]
        assert np.allclose([out[i].p for i in ids], p, atol=1e-6)
        for j in range(3):
            oof[inners[:, s] == j] = solve(x[on & (inners[:, s] != j)], y[on & (inners[:, s] != j)], 2)[1](x[inners[:, s] == j])
        gain = [((oof[on] > t) * (2 * y[on] - 1)).sum() for t in gate.THRESHOLDS]
        assert {out[i].t for i in ids} == {gate.THRESHOLDS[int(np.argmax(gain))]} and {out[i].kind for i in ids} == {"logreg"}


def test_one_class_and_no_rows(spark):
    _, df = data(spark, 60)
    same = crossfit.cross_fit(df.withColumn("help", F.lit(1.0)), ["a"], ["c"], folds=3)
    assert same.count() == 60 and same.where("p = 0.5").count() == 60
    assert crossfit.cross_fit(df.where("false"), ["a"], ["c"], folds=3).count() == 0


def boosted(x, y, edges, rounds, rate=0.05, depth=3, least=20):
    """Trees by trying every split of every node over explicit rows: [(column, bin, nulls left, left, right) or a leaf's value]."""
    b = np.column_stack([np.where(np.isnan(x[:, c]), 255, np.searchsorted(e, x[:, c])) for c, e in enumerate(edges)])
    sw = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    margin, trees = np.zeros(len(y)), []

    def grow(on, g, h, level):
        best = None
        for null in (False, True) if level < depth else ():
            for c in range(b.shape[1]):
                for t in range(255):
                    left = on & np.where(b[:, c] == 255, null, b[:, c] <= t)
                    right = on & ~left
                    if min(left.sum(), right.sum()) < least or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) - g[on].sum() ** 2 / h[on].sum()
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, c, t, null, left, right)
        if best is None:
            value = 0.0 if level == 0 else -rate * g[on].sum() / h[on].sum()
            return value, np.where(on, value, 0.0)
        parts = [grow(side, g, h, level + 1) for side in best[4:]]
        return (*best[1:4], parts[0][0], parts[1][0]), parts[0][1] + parts[1][1]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree, add = grow(np.ones(len(y), bool), sw * (p - y), sw * p * (1 - p), 0)
        trees.append(tree)
        margin = margin + add
    return trees, margin


def nested(tree, node=0):
    c, b, null, left, right = tree.nodes[node]
    return round(tree.value[node], 9) if c < 0 else (c, b, null, nested(tree, left), nested(tree, right))


def rounded(tree):
    return round(tree, 9) if isinstance(tree, float) else (*tree[:3], rounded(tree[3]), rounded(tree[4]))


def test_boosted_trees_are_those_of_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)  # margins are brought up to date in between
    rows, df = data(spark, 500, seed=8)
    made, names, numbers = crossfit.design(df, ["a", "b"], ["c"])
    made, splits = crossfit.assign(made, 4, 3, None, "help")
    made = made.withColumn("y", F.col("help")).persist()
    found = {r.id: r for r in made.collect()}
    fitted = boosting.Boosted(rounds=3).fit(made, list(range(splits.models)), 3, numbers)
    x = np.array([[np.nan if v is None else v for v in found[r[0]].x] for r in rows])
    y = wide(rows)[1]
    for m in (0, 7, 15):
        on = np.array([found[r[0]].inners[m // 4] not in (-1, m % 4) for r in rows])
        trees, margin = boosted(x[on], y[on], fitted.edges, 3)
        assert [nested(t) for t in fitted.trees[m]] == [rounded(t) for t in trees], m
        assert np.allclose(fitted.margin(m, x[on]), margin, atol=1e-9)
    made.unpersist()


def test_cross_fit_picks_the_better_kind(spark):
    """A label that only trees can tell; and one number of models for both kinds."""
    rng = np.random.default_rng(0)
    v = rng.uniform(-1, 1, size=(600, 2))
    rows = [(i % 30, float(a), float(b), float(a * b > 0)) for i, (a, b) in enumerate(v)]
    df = spark.createDataFrame(rows, "template int, a double, b double, help double")
    out = crossfit.cross_fit(df, ["a", "b"], [], [crossfit.Linear(), boosting.Boosted(rounds=4)], folds=3, inner=2).collect()
    assert {r.kind for r in out} == {"gbm"} and np.mean([(r.p > 0.5) == (r.help > 0.5) for r in out]) > 0.75
    one = crossfit.fit_all(df, ["a", "b"], [], boosting.Boosted(rounds=2)).collect()
    assert len(one) == 600 and len({round(r.p, 9) for r in one}) > 1
