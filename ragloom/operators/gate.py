"""The answer gate: features, label, exact metrics, grouped splits, and cross-fitted models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text

THRESHOLDS = [i / 100.0 for i in range(30, 71, 5)]
RANGES = 256  # of scores, when ranks are made
LARGEST, STRETCHES = 1024, 4096  # groups that are packed one by one; hash ranges of the others
RETRIEVAL = ["r_max", "r_mean", "r_min", "r_gap", "n_cards"]
BEHAVIOUR = ["base_agree", "base_in_cards", "rag_in_cards", "changed", "rag_base_overlap", "base_len", "rag_len"]
CONTEXT = ["is_english"]
JUDGE = "judge_yes"


def help_label(before: Column, after: Column) -> Column:
    """1 where the second system is better, 0 where it is worse, null for ties and unscored rows."""
    return F.when(before.isNull() | after.isNull() | (before == after), F.lit(None)).otherwise((after > before).cast("double"))


def score_features(scores: Column) -> dict[str, Column]:
    """Greatest, mean, least, lead of the first over the second (0 for no second), and count of an array of scores."""
    down = F.sort_array(scores, asc=False)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    second = F.coalesce(F.try_element_at(down, F.lit(2)), F.lit(0.0))
    return {
        "r_max": F.try_element_at(down, F.lit(1)), "r_mean": F.when(F.size(scores) > 0, total / F.size(scores)), "r_min": F.array_min(scores),
        "r_gap": F.try_element_at(down, F.lit(1)) - second, "n_cards": F.size(scores),
    }


def answer_features(before: Column, after: Column, reference: Column) -> dict[str, Column]:
    """Overlaps, change and lengths of two answers; `reference` is the cards' text."""
    words = text.content_words
    ref = words(reference)
    return {
        "base_in_cards": text.overlap_share(words(before), ref), "rag_in_cards": text.overlap_share(words(after), ref),
        "changed": (text.normalize(before) != text.normalize(after)).cast("int"),
        "rag_base_overlap": text.overlap_share(words(after), words(before)),
        "base_len": text.word_count(before), "rag_len": text.word_count(after),
    }


def agreement(answers: DataFrame, keys: list[str], prompt: str, first: str, second: str, response: str = "response") -> DataFrame:
    """Whether a system gives the same normalised answer under two prompts."""
    side = lambda p: F.min(F.when(F.col(prompt) == p, text.normalize(F.col(response))))
    return answers.groupBy(*keys).agg(side(first).alias("a"), side(second).alias("b")).select(*keys, F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0)).alias("agree"))


def auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) per group: mean ranks, then the rank sum of the positives. Groups of one class go.

    Ranks come from counts per distinct score, so that a group's rows are pre-aggregated before any window. Windows run within
    ranges of scores, cut at `RANGES` quantiles; what lies below a range is one number per group and range."""
    keys = keys or []
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    per = rows.groupBy(*keys, score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
    cuts = per.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)]).alias("__cuts"))
    per = per.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(score)))).drop("__cuts")
    w = Window.partitionBy(*keys, "__range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per.groupBy(*keys, "__range").agg(F.sum("n").alias("__n")).withColumn("__below", F.coalesce(F.sum("__n").over(below), F.lit(0.0))).drop("__n")
    per = per.join(ranges, [*keys, "__range"])
    per = per.withColumn("rank", F.col("__below") + F.coalesce(F.sum("n").over(w), F.lit(0.0)) + (F.col("n") + 1) / 2)
    total = per.groupBy(*keys).agg(F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    total = total.where((F.col("n1") > 0) & (F.col("n0") > 0))
    return total.select(*keys, F.round((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0")), 6).alias("auc"))


def gains(df: DataFrame, thresholds: DataFrame, label: str = "help", p: str = "p", t: str = "t", keys: list[str] | None = None) -> DataFrame:
    """Answers won less answers lost by threshold (and keys), where the gate opens above it."""
    per = df.where(F.col(label).isNotNull()).crossJoin(F.broadcast(thresholds))
    use = F.coalesce(F.col(p) > F.col(t), F.lit(False))
    return per.groupBy(*keys or [], "pos", t).agg(F.sum(F.when(use, 2 * F.col(label) - 1).otherwise(0)).cast("long").alias("gain"))


def hash_folds(key: Column, k: int) -> Column:
    """A fold for a group key, the same for all its rows."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")


def balanced_folds(df: DataFrame, group: str, k: int, largest: int = LARGEST) -> DataFrame:
    """(group, fold): all rows of a group in one fold, folds balanced by rows."""
    return packed_folds(df.groupBy(group).agg(F.count("*").alias("n")), group, k, largest=largest)


def packed_folds(sizes: DataFrame, group: str, k: int, keys: list[str] | None = None, largest: int = LARGEST) -> DataFrame:
    """(keys, group, fold) from (keys, group, n), packed for each of the keys alone.

    The `largest` groups go one by one, from the largest (of equals the first), to the fold with the fewest rows. The rest, in order of
    a hash, fill what each fold then lacks of an even share: a group goes to the fold in whose stretch its running sum begins. So
    folds differ by one of the rest's groups at most from what greedy packing of all would give, and no task holds more than `largest` groups."""
    keys = keys or []
    by_keys = lambda *c: Window.partitionBy(*keys, *c)
    ranked = sizes.withColumn("rank", F.row_number().over(by_keys().orderBy(F.desc("n"), F.col(group).asc_nulls_first())))
    first = ranked.where(F.col("rank") <= largest)
    nothing = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("loads"), F.array().cast("array<int>").alias("folds"))

    def pack(state, x):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, i: F.when(i == at, load + x["n"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["folds"], F.array(at)).alias("folds"))

    heads = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(group).alias("g"), F.col("n").cast("long").alias("n")))).alias("all_of"))
    heads = heads.withColumn("packed", F.aggregate("all_of", nothing, pack))
    done = heads.select(*keys, F.explode(F.arrays_zip(F.col("all_of.g").alias("g"), F.col("packed.folds").alias("f"))).alias("x")).select(*keys, F.col("x.g").alias(group), F.col("x.f").alias("fold"))
    if not ranked.where(F.col("rank") == largest + 1).limit(1).count():
        return done
    same = F.col("g_").eqNullSafe(F.col(group))
    for c in keys:
        same = same & F.col(f"k_{c}").eqNullSafe(F.col(c))
    names = [F.col(c).alias(f"k_{c}") for c in keys]
    rest = sizes.join(first.select(*names, F.col(group).alias("g_")), same, "left_anti").withColumn("b", hash_folds(F.coalesce(F.col(group).cast("string"), F.lit("")), STRETCHES))
    sums = rest.groupBy(*keys, "b").agg(F.sum("n").alias("sum"))
    sums = sums.withColumns({"before": F.sum("sum").over(by_keys().orderBy("b")) - F.col("sum"), "total": F.sum("sum").over(by_keys())})
    rest = rest.join(sums.select(*[F.col(c).alias(f"k_{c}") for c in keys], F.col("b").alias("b_"), "before", "total"), _same(keys, "b"))
    rest = rest.withColumn("start", F.col("before") + F.sum("n").over(by_keys("b").orderBy(F.col(group).asc_nulls_first())) - F.col("n")).drop("b_", *[f"k_{c}" for c in keys])
    loads = heads.select(*names, F.col("packed.loads").alias("loads"))
    rest = rest.join(F.broadcast(loads), _same(keys)) if keys else rest.crossJoin(F.broadcast(loads))
    up = F.array_sort("loads")
    levels = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda m: (F.col("total") + F.aggregate(F.slice(up, F.lit(1), m), F.lit(0).cast("long"), lambda s, x: s + x)) / m)
    lacks = F.transform("loads", lambda x: F.greatest(F.lit(0.0), F.array_min(levels) - x))
    ends = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(F.slice(lacks, F.lit(1), i), F.lit(0.0), lambda s, x: s + x))
    at = F.least(F.lit(k - 1), F.size(F.filter(ends, lambda e: e <= F.col("start"))))
    return done.unionByName(rest.select(*keys, group, at.cast("int").alias("fold")))


def _same(keys: list[str], *more: str) -> Column:
    out = F.lit(True)
    for c, other in [*((c, f"k_{c}") for c in keys), *((c, f"{c}_") for c in more)]:
        out = out & F.col(c).eqNullSafe(F.col(other))
    return out


def loco(df: DataFrame, fold: str, part: str, k: int) -> DataFrame:
    """Leave one partition and one fold out: (test_fold, test_part) with each row's role; rows with neither role go."""
    spark = df.sparkSession
    parts = df.select(F.col(part).alias("test_part")).distinct()
    splits = F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("test_fold"))).crossJoin(parts)
    rows = df.crossJoin(F.broadcast(splits))
    train = (F.col(fold) != F.col("test_fold")) & (F.col(part) != F.col("test_part"))
    test = (F.col(fold) == F.col("test_fold")) & (F.col(part) == F.col("test_part"))
    return rows.withColumn("role", F.when(train, "train").when(test, "test")).where("role is not null")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (2 n_c): one row per class, joined back."""
    n = df.groupBy(label).agg(F.count("*").alias("n_c"))
    total = F.sum("n_c").over(Window.partitionBy())
    return df.join(F.broadcast(n.withColumn("weight", total / (2.0 * F.col("n_c"))).drop("n_c")), label)


def population_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns({f"{c}_scaled": e for c, e in scaled.items()})


def estimator(kind: str, numeric: list[str], categorical: list[str], label: str = "help", rows: int = 2, strength: float = 1.0, iterations: int = 200):
    """Standardised numbers (population deviation) and one-hot categories, where a category that was not seen is all zeros, into a
    logistic regression with squared penalty 1 / `strength` or boosted trees. `rows`: how many it will be fitted on."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_h" for c in categorical], dropLast=True)] if categorical else []
    wide = [VectorAssembler(inputCols=numeric, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="sample", withMean=True, withStd=True)]
    population = ElementwiseProduct(inputCol="sample", outputCol="scaled", scalingVec=Vectors.dense([(rows / max(1, rows - 1)) ** 0.5] * len(numeric)))
    all_of = VectorAssembler(inputCols=["scaled", *[f"{c}_h" for c in categorical]], outputCol="features")
    if kind == "logreg":  # weights sum to `rows`, and the mean loss stands for the sum
        model = LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / (strength * max(1, rows)), standardization=False, maxIter=2000)
    else:
        model = GBTClassifier(labelCol=label, weightCol="weight", maxDepth=3, stepSize=0.05, maxIter=iterations, seed=0)
    return Pipeline(stages=[*index, *hot, *wide, population, all_of, model])


def fit(train: DataFrame, kind: str, numeric: list[str], categorical: list[str], label: str = "help", **options):
    """A category column that has one value in `train` tells nothing and is left out."""
    train = train.where(F.col(label).isNotNull())
    found = train.agg(F.count("*").alias("__rows"), *[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
    varied = [c for c in categorical if found[c] > 1]
    return estimator(kind, numeric, varied, label, found["__rows"], **options).fit(class_weights(train, label))


def predict(model, rows: DataFrame, out: str = "p") -> DataFrame:
    keep = rows.columns
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias(out))


def feature_sets(df: DataFrame) -> dict[str, list[str]]:
    """Number columns by name of the set. The full set is there only if every row has the judge's probability."""
    sets = {"retrieval": RETRIEVAL + CONTEXT, "no_judge": RETRIEVAL + BEHAVIOUR + CONTEXT}
    if JUDGE in df.columns and not df.where(F.col(JUDGE).isNull()).take(1):
        sets["full"] = sets["no_judge"] + [JUDGE]
    return sets


def report(df: DataFrame, part: str, label: str = "help", p: str = "p", t: str = "t") -> DataFrame:
    """(place, line): AUC and shares kept over all rows, then by part in its order. A part with one class has no line."""
    use = decide(F.col(p), F.col(t)).cast("int")
    share = lambda c: F.format_string("%.1f%%", F.coalesce(100 * F.avg(c), F.lit(0.0)))
    kept = [share(use).alias("kept"), share(F.when(F.col(label) == 1, use)).alias("won"), share(F.when(F.col(label) == 0, use)).alias("lost")]
    head = df.agg(*kept).crossJoin(auc(df, label, p))
    first = F.format_string("AUC %.3f; kept for %s of rows; help kept %s, hurt kept %s", "auc", "kept", "won", "lost")
    each = df.groupBy(part).agg(*kept).join(auc(df, label, p, [part]), part)
    line = F.format_string("    %-12s AUC %.3f  kept %s", F.col(part), F.col("auc"), F.col("kept"))
    return head.select(F.lit("").alias("place"), first.alias("line")).union(each.select(F.concat(F.lit("1"), part).alias("place"), line.alias("line")))


def decide(p: Column, t: Column) -> Column:
    return F.coalesce(p > t, F.lit(False))


def overlay(base: DataFrame, decided: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores of all rows: the decided ones where there are any."""
    joined = base.join(decided.select(*keys, F.col("s")), keys, "left")
    return joined.withColumn(score, F.coalesce("s", score)).drop("s")


def best_of_two(a: Column, b: Column) -> Column:
    """The greater, skipping nulls and NaN."""
    clean = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return F.greatest(clean(a.cast("double")), clean(b.cast("double")))
