"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag holds its character n-grams, hashed into rows of an embedding table; the bag's average goes through a
linear softmax with two classes. A document's logit is the log-sum-exp of its distinct words' logits: one abusive word in
thousands counts, and a misspelling that was never seen shares most of its n-grams with its model. Embeddings and
softmax learn together by Adam on the documents' labels; Platt's scaling on a held-back fifth of the training rows makes the
score a probability.

Labels come from at most about `TRAIN_ROWS` labelled rows per class, picked by a hash of doc_id. Scoring covers every
document and its whole text. Memory: one task holds the training rows' distinct words, as indexes; a scoring task holds one Arrow batch and a bounded memo of word logits.

Defined results: null and empty texts have no words and get the score of an empty bag sum (low); without labels of both
classes every score is 0; a score of just the threshold is predicted 1; repeated rows are scored each; texts of any length are scored whole; other columns are ignored or, in `keep_clean`, carried along.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 3_000
THRESHOLD = 0.7
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 4
EPOCHS = 40
DECAY = 3e-6
STRIP = ".,;:!?\"'()[]{}#$%&*+=~^|<>-_"
EMPTY_LOGIT = -6.0
WORDS_AT_ONCE = 1 << 15


def words(text: str) -> list[str]:
    return text.lower().split()


def bags(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, `<` before and `>` after each, a bounded number of words at once: (buckets, first index of each word)."""
    if len(vocabulary) > WORDS_AT_ONCE:
        parts = [bags(vocabulary[s : s + WORDS_AT_ONCE]) for s in range(0, len(vocabulary), WORDS_AT_ONCE)]
        before = np.cumsum([0, *(len(g) for g, _ in parts[:-1])])
        return np.concatenate([g for g, _ in parts]), np.concatenate([first + b for (_, first), b in zip(parts, before)])
    joined = "".join(f"<{w.strip(STRIP) or w}>" for w in vocabulary)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w.strip(STRIP) or w) + 2 for w in vocabulary], dtype=np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[owner] - np.arange(len(points))
    grams, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        inside = np.flatnonzero(left >= n)
        h = np.full(len(inside), n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = common.mix64(h * np.uint64(0x100000001B3) + points[inside + i])
        grams.append((h % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[inside])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    g, o = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return g[order], np.searchsorted(o[order], np.arange(len(sizes)))


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.softmax = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.scale, self.shift, self.trained = 1.0, 0.0, False

    def row_logits(self) -> np.ndarray:
        """Each embedding row's part in the logit; the average of a bag's parts is the softmax of its average."""
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    def word_logits(self, vocabulary: list[str], parts: np.ndarray | None = None) -> np.ndarray:
        """Every word has a boundary on each side, so at least one n-gram."""
        if not vocabulary:
            return np.zeros(0)
        grams, first = bags(vocabulary)
        parts = self.row_logits() if parts is None else parts
        counts = np.diff(np.append(first, len(grams)))
        return np.add.reduceat(parts[grams], first) / counts + float(self.bias[1] - self.bias[0])

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(logits))
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def pool(logits: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log(exp(EMPTY_LOGIT) + sum of exp) over each document's words."""
    e = np.exp(np.minimum(logits, 60))
    total = np.zeros(len(first))
    some = counts > 0
    if some.any():
        total[some] = np.add.reduceat(e, first[some])
    return np.log(np.exp(EMPTY_LOGIT) + total)


def index(texts: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; each document's distinct words as indexes, one document after the other; first index, counts."""
    ids: dict[str, int] = {}
    rows = [np.unique(np.array([ids.setdefault(w, len(ids)) for w in words(t)], dtype=np.int32)) for t in texts]
    counts = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return list(ids), flat, np.cumsum(counts) - counts, counts


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m = self.m.setdefault(name, np.zeros_like(value))
        v = self.v.setdefault(name, np.zeros_like(value))
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def fit(rows: Iterable[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Joint training of embeddings, softmax and bias on (text, label); then Platt's scaling on every fifth row, which training
    leaves out. Rows are read once, and only their distinct words' indexes are kept."""
    model, labels = Model(seed), []

    def texts():
        for text, label in rows:
            labels.append(label)
            yield text

    vocabulary, flat, first, counts = index(texts())
    y = np.asarray(labels, dtype=np.float64)
    if len(np.unique(y)) < 2:
        return model
    grams, begin = bags(vocabulary)
    per_word = np.diff(np.append(begin, len(grams)))
    back = np.zeros(len(y), dtype=bool)
    for value in (0, 1):
        back[np.flatnonzero(y == value)[4::5]] = True
    weight = np.where(y == 1, 0.5 / max(1, y[~back].sum()), 0.5 / max(1, (1 - y[~back]).sum())) * ~back
    owner = np.repeat(np.arange(len(y)), counts)
    gram_word = np.repeat(np.arange(len(vocabulary), dtype=np.int32), per_word)
    adam = Adam(0.05)
    model.bias[:] = (1.0, -1.0)

    def logits():
        parts = model.row_logits()
        z = np.add.reduceat(parts[grams], begin) / per_word + float(model.bias[1] - model.bias[0]) if len(vocabulary) else np.zeros(0)
        return z, pool(z[flat], first, counts)

    for _ in range(epochs):
        adam.t += 1
        z, pooled = logits()
        error = (1 / (1 + np.exp(-pooled)) - y) * weight
        share = np.exp(np.minimum(z[flat], 60) - pooled[owner])
        by_word = np.bincount(flat, weights=error[owner] * share, minlength=len(vocabulary))
        by_row = np.bincount(grams, weights=(by_word / per_word)[gram_word], minlength=BUCKETS)
        difference = model.softmax[:, 1] - model.softmax[:, 0]
        to_softmax = (by_row @ model.embedding).astype(np.float32)
        adam.step("embedding", model.embedding, np.outer(by_row, difference).astype(np.float32) + DECAY * model.embedding)
        adam.step("softmax", model.softmax, np.stack([-to_softmax, to_softmax], axis=1))
        adam.step("bias", model.bias, np.array([-by_word.sum(), by_word.sum()], dtype=np.float32))
    _, pooled = logits()
    x, target = pooled[back], y[back]
    if len(np.unique(target)) < 2:
        x, target = pooled, y
    n1, n0 = target.sum(), (1 - target).sum()
    soft = np.where(target == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g, w = p - soft, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * x).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    model.scale, model.shift, model.trained = max(float(a), 1e-3), float(b), True
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about `rows` labelled documents per class outside the held-out third, by a hash of doc_id."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    label = label.where("toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    n = {r.toxic: r["count"] for r in label.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, rows / max(1, n.get(0, 0)))))
    place = common.unit_interval(F.xxhash64("doc_id"))
    label = label.where(place < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    joined = texts.join(F.broadcast(label), "doc_id")
    return joined.select("doc_id", "text", "toxic")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits in one task, so that the driver gets the model (4 MB) and no texts; a lost executor's task runs again."""
    common.ship(docs.sparkSession)

    def run(batches):
        import pickle

        import pyarrow as pa

        parts = (b.slice(s, 64) for b in batches for s in range(0, b.num_rows, 64))
        model = fit(row for p in parts for row in zip(p.column("text").to_pylist(), p.column("toxic").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    import pickle

    ordered = training_rows(docs, labels, rows).repartition(1).sortWithinPartitions("doc_id", "text", "toxic")
    fitted = ordered.mapInArrow(common.tidy(run), "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else Model()


def scorer(model: Model):
    """A function from texts to probabilities, with a bounded memo of word logits."""
    parts = model.row_logits()
    memo: dict[str, float] = {}

    def score(texts: list[str]) -> np.ndarray:
        if len(memo) > 300_000:
            memo.clear()
        each = [set(words(t)) for t in texts]
        fresh = list(set().union(*each).difference(memo)) if each else []
        memo.update(zip(fresh, np.exp(np.minimum(model.word_logits(fresh, parts), 60)).tolist()))
        get = memo.__getitem__
        total = np.array([sum(map(get, sorted(s))) for s in each], dtype=np.float64)
        return model.probability(np.log(np.exp(EMPTY_LOGIT) + total))

    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), common.text_or_empty().alias("text"))

    def run(batches):
        import pyarrow as pa

        of = scorer(sent.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                p = of(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(common.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more; all columns are kept."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        of = scorer(sent.value)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield part.filter(pa.array(of([t or "" for t in texts]) < threshold))

    return common.map_rows(docs, run)
