"""Nested cross-fitting of the gate: every model of every split at once.

A row carries, for each split, the inner fold it has there, or -1 where that split doesn't train on it. So one pass over the rows
serves all models: those of the inner folds, which give out-of-fold scores to choose a classifier and a threshold by, and the
refitted one of each split, which scores the rows the split holds out. Passes send sums per model, which are as many as splits times
features squared (linear) or bins (boosted), however many rows there are.

Rows without a label are scored and train nothing. A null number is the mean to the linear model and a side of its own to the
boosted one; a category that a model has not seen weighs nothing; a column without spread weighs nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gate

STEPS, TOLERANCE = 60, 1e-9


class Splits:
    """Which rows each split trains on and holds out. `parts`: values of the column `part`, each left out in turn within each fold;
    none: folds only. Model m is inner fold m % (inner + 1) of split m // (inner + 1), the last of them the refitted one."""

    def __init__(self, folds: int, inner: int, part: str | None, parts: list):
        self.folds, self.inner, self.part, self.parts = folds, inner, part, parts
        self.count = folds * (len(parts) if part else 1)
        self.models = self.count * (inner + 1)

    def of(self, fold, place) -> F.Column:
        """The split that holds out a row of this fold and place among the parts."""
        return (fold * len(self.parts) + place if self.part else fold).cast("int")

    def trains(self, s, fold, place) -> F.Column:
        """Whether split `s` may train on a row of this fold and place."""
        if not self.part:
            return s != fold
        return (F.floor(s / len(self.parts)) != fold) & (s % len(self.parts) != place)


def assign(df: DataFrame, folds: int, inner: int, part: str | None, label: str, group: str = "template") -> tuple[DataFrame, Splits]:
    """`df` with `fold`, `split` (the one that holds a row out) and `inners`."""
    outer = gate.balanced_folds(df, group, folds)
    rows = df.join(outer.withColumnRenamed(group, "g_"), F.col(group).eqNullSafe(F.col("g_"))).drop("g_")
    parts = sorted((r[0] for r in df.select(part).distinct().collect()), key=lambda v: (v is not None, v)) if part else []
    splits = Splits(folds, inner, part, parts)
    place = F.lit(0)
    for i, v in enumerate(parts):
        place = F.when(F.col(part).eqNullSafe(F.lit(v)), i).otherwise(place)
    rows = rows.withColumn("place", place.cast("int"))
    all_splits = F.sequence(F.lit(0), F.lit(splits.count - 1))
    trains = lambda s: splits.trains(s, F.col("fold"), F.col("place"))
    sizes = rows.where(F.col(label).isNotNull()).groupBy(group, "fold", "place").agg(F.count("*").alias("n"))
    sizes = sizes.select(group, "n", F.explode(F.filter(all_splits, trains)).alias("s_")).groupBy("s_", group).agg(F.sum("n").alias("n"))
    packed = gate.packed_folds(sizes, group, inner, ["s_"])
    packed = packed.groupBy(F.col(group).alias("g_")).agg(F.map_from_entries(F.collect_list(F.struct("s_", "fold"))).alias("known"))
    rows = rows.join(packed, F.col(group).eqNullSafe(F.col("g_")), "left").drop("g_")
    mine = lambda s: F.when(F.col(label).isNotNull() & trains(s), F.coalesce(F.try_element_at("known", s), F.lit(-1))).otherwise(F.lit(-1))
    rows = rows.withColumns({"inners": F.transform(all_splits, mine), "split": splits.of(F.col("fold"), F.col("place"))})
    return rows.drop("known", "place"), splits


def design(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str], int]:
    """`df` with `x`: numbers in units of all rows' deviation, then one column per category; the columns' names, and how many are numbers."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    x, names = [], list(numeric)
    for c in numeric:
        x.append((F.col(c) - F.lit(float(stats[f"m_{c}"] or 0.0))).cast("double") / F.lit(float(stats[f"s_{c}"] or 1.0)))
    for c in categorical:
        for v in sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()):
            names.append(f"{c}={v}")
            x.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)))
    return df.withColumn("x", F.array(*x)), names, len(numeric)


def arrays(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and inners of a batch; NaN for nulls."""
    wide = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
    return wide(b.column("x")).astype(float), b.column("y").to_numpy(zero_copy_only=False).astype(float), wide(b.column("inners")).astype(np.int64)


def trained_on(inners: np.ndarray, model: int, inner: int) -> np.ndarray:
    of = inners[:, model // (inner + 1)]
    return (of >= 0) & (of != model % (inner + 1))


def sums(rows: DataFrame, models: list[int], inner: int, measure) -> dict[int, np.ndarray]:
    """`measure`(model, x, y) summed over the rows that each model trains on: partial sums per task, one vector per model to the driver."""

    def run(batches):
        import pyarrow as pa

        total = {}
        for b in batches:
            x, y, inners = arrays(b)
            for m in models if b.num_rows else []:
                on = trained_on(inners, m, inner)
                if on.any():
                    total[m] = total.get(m, 0) + measure(m, x[on], y[on])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["model", "v"])

    found = rows.select("x", "y", "inners").mapInArrow(run, "model int, v array<double>").withColumn("v", array_to_vector("v"))
    found = found.groupBy("model").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
    return {r.model: np.array(r.v) for r in found.collect()}


class Scale:
    """Mean, deviation and class weights of each model's rows."""

    def __init__(self, rows: DataFrame, models: list[int], inner: int, numbers: int):
        def measure(m, x, y):
            here = ~np.isnan(x)
            z = np.where(here, x, 0.0)
            return np.concatenate([[len(y), y.sum()], here.sum(0), z.sum(0), (z * z).sum(0)])

        self.mean, self.deviation, self.weight = {}, {}, {}
        for m, v in sums(rows, models, inner, measure).items():
            (n, ones), (count, total, squares) = v[:2], v[2:].reshape(3, -1)
            if not 0 < ones < n:
                continue  # one class: nothing to learn
            mean = total / np.maximum(count, 1)
            deviation = np.sqrt(np.maximum(squares / np.maximum(count, 1) - mean**2, 0.0))
            deviation[deviation < 1e-12] = 1.0
            mean[numbers:], deviation[numbers:] = 0.0, 1.0
            self.mean[m], self.deviation[m], self.weight[m] = mean, deviation, (n / (2 * (n - ones)), n / (2 * ones))

    def apply(self, m: int, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.mean[m]) / self.deviation[m])


class Linear:
    """Logistic regressions with squared penalty 1 / `strength` and balanced classes, by Newton steps of all models together. A step that
    raises a model's loss is halved."""

    name = "logreg"

    def __init__(self, strength: float = 1.0):
        self.strength = strength

    def fit(self, rows: DataFrame, models: list[int], inner: int, numbers: int) -> Linear:
        self.scale = scale = Scale(rows, models, inner, numbers)
        open_ = sorted(scale.mean)
        width = len(scale.mean[open_[0]]) + 1 if open_ else 0
        now = {m: np.zeros(width) for m in open_}
        self.weights, best, strength = dict(now), {}, self.strength
        penalty = np.append(np.ones(width - 1), 0.0) / strength if width else None
        for _ in range(STEPS):
            if not open_:
                break
            at = {m: now[m] for m in open_}

            def measure(m, x, y, at=at):
                z = np.column_stack([scale.apply(m, x), np.ones(len(x))])
                margin = z @ at[m]
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                w = np.where(y > 0.5, scale.weight[m][1], scale.weight[m][0])
                loss = (w * (np.logaddexp(0, margin) - y * margin)).sum()
                return np.concatenate([[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

            found, left = sums(rows, open_, inner, measure), []
            for m in open_:
                v, w = found[m], now[m]
                loss = v[0] + 0.5 * (penalty * w * w).sum()
                if m in best and loss > best[m] + 1e-12 * abs(best[m]):
                    now[m] = (w + self.weights[m]) / 2
                    left.append(m)
                    continue
                best[m], self.weights[m] = loss, w
                gradient = v[1 : 1 + width] + penalty * w
                step = np.linalg.solve(v[1 + width :].reshape(width, width) + np.diag(penalty + 1e-12), gradient)
                now[m] = w - step
                if np.abs(step).max() < TOLERANCE:
                    self.weights[m] = now[m]
                else:
                    left.append(m)
            open_ = left
        return self

    def margin(self, m: int, x: np.ndarray) -> np.ndarray:
        """Log-odds; 0 where nothing could be learned."""
        if m not in self.weights:
            return np.zeros(len(x))
        return self.scale.apply(m, x) @ self.weights[m][:-1] + self.weights[m][-1]

    def coefficients(self, m: int, names: list[str]) -> list[tuple[str, float]]:
        """Names and weights in units of deviation, from the most negative."""
        return sorted(zip(names, self.weights[m][:-1].tolist()), key=lambda x: x[1])


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def out_of_fold(rows: DataFrame, fitted, inner: int) -> DataFrame:
    """(split, help, p) of each row under the inner models that haven't seen its group."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y, inners = arrays(b)
            split, help_, p = [], [], []
            for s in range(inners.shape[1] if b.num_rows else 0):
                for j in range(inner):
                    on = inners[:, s] == j
                    if on.any():
                        split.append(np.full(on.sum(), s, dtype=np.int32))
                        help_.append(y[on])
                        p.append(probability(fitted.margin(s * (inner + 1) + j, x[on])))
            if split:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (split, help_, p)], ["split", "help", "p"])

    return rows.select("x", "y", "inners").mapInArrow(run, "split int, help double, p double")


def choose(rows: DataFrame, fitted: list, splits: Splits) -> dict[int, tuple[int, float]]:
    """Per split: which of the fitted kinds has the best out-of-fold AUC, and the threshold with its best gain; the first of equals."""
    grid = rows.sparkSession.createDataFrame(list(enumerate(gate.THRESHOLDS)), "pos int, t double")
    found = {}
    for i, kind in enumerate(fitted):
        oof = out_of_fold(rows, kind, splits.inner).persist()
        won = gate.gains(oof, grid, keys=["split"]).groupBy("split").agg(F.max_by("t", F.struct(F.col("gain"), -F.col("pos"))).alias("t"))
        ranked = {r.split: r.auc for r in gate.auc(oof, "help", "p", ["split"]).collect()}
        for r in won.collect():
            score = ranked.get(r.split, 0.5)
            if r.split not in found or score > found[r.split][0]:
                found[r.split] = (score, i, float(r.t))
        oof.unpersist()
    return {s: (i, t) for s, (_, i, t) in found.items()}


def cross_fit(
    df: DataFrame, numeric: list[str], categorical: list[str], kinds: list | None = None, folds: int = 5, inner: int = 3, label: str = "help", part: str | None = None, group: str = "template"
) -> DataFrame:
    """`df` with `p`, `t` and `kind`: the probability, threshold and classifier of the split that holds a row's group out, and with
    `part` (a country, say) its part as well. Folds are grouped and balanced by rows."""
    rows, names, numbers = design(df, numeric, categorical)
    rows, splits = assign(rows, folds, inner, part, label, group)
    rows = rows.withColumn("y", F.col(label).cast("double")).persist()
    fitted = [kind.fit(rows, list(range(splits.models)), inner, numbers) for kind in kinds or [Linear()]]
    chosen = choose(rows, fitted, splits)
    names = [kind.name for kind in fitted]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, _, _ = arrays(b)
            split = b.column("split").to_numpy(zero_copy_only=False)
            p, t, kind = np.full(len(x), 0.5), np.full(len(x), 0.5), np.zeros(len(x), dtype=int)
            for s in np.unique(split):
                on = split == s
                i, threshold = chosen.get(int(s), (0, 0.5))
                p[on] = probability(fitted[i].margin(int(s) * (inner + 1) + inner, x[on]))
                t[on], kind[on] = threshold, i
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(p), pa.array(t), pa.array([names[i] for i in kind], pa.string())], [*keep, "p", "t", "kind"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    keep = df.columns
    schema = StructType(list(df.schema.fields)).add("p", DoubleType()).add("t", DoubleType()).add("kind", StringType())
    out = rows.select(*keep, *[c for c in ("x", "y", "inners", "split") if c not in keep]).mapInArrow(run, schema).persist()
    out.count()  # so that `rows` can go
    rows.unpersist()
    return out


def fit_all(df: DataFrame, numeric: list[str], categorical: list[str], kind, label: str = "help") -> DataFrame:
    """`df` with `p` by one model of all its labelled rows."""
    rows, _, numbers = design(df, numeric, categorical)
    of = F.array(F.when(F.col(label).isNotNull(), F.lit(1)).otherwise(F.lit(-1)))
    rows = rows.withColumns({"y": F.col(label).cast("double"), "inners": of}).persist()
    fitted = kind.fit(rows, [0], 0, numbers)
    keep = df.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(probability(fitted.margin(0, arrays(b)[0])))], [*keep, "p"])

    from pyspark.sql.types import DoubleType, StructType

    out = rows.mapInArrow(run, StructType(list(df.schema.fields)).add("p", DoubleType())).persist()
    out.count()  # so that `rows` can go
    rows.unpersist()
    return out
