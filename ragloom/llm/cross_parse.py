"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A document is parsed greedily into phrases, each the longest match of what
is left of it in that text; the language that needs the fewest phrases, normalised by the bits that name a place in its text
(log2 of its length), wins. The ratio of phrases to length is an estimate of the cross entropy.

Text is lower-cased; runs of what are neither letters nor marks become one blank; then its UTF-8 bytes are parsed, so any script has 256
symbols at most. A byte that a language's text never has ends the phrase it interrupts, or is a phrase itself. Documents are parsed in
pieces of `PIECE` bytes, whose phrases are summed, so thousands of pieces of all lengths step through dense transition tables
side by side; whole texts are parsed.

Learning: per language a bounded sample of pieces of labelled text, about `TRAIN_BYTES` at most (and `TOTAL_BYTES` for all languages, of
which the `LANGUAGES` most frequent are learned). A piece is in the sample by its own hash, so copies count once. One task per language
builds the automaton; the driver and each worker hold the models: per language at most 2 states a byte, 4 bytes each times the
distinct bytes seen.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text where nothing was learned; ties go to the
language with more labelled rows, then to the first by name; with one language alone the score is 1; null doc_ids aren't held out; repeated rows
are judged each; texts of any length are parsed whole; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECE = 1_024
SAMPLE_PIECE = 256
TRAIN_BYTES, TOTAL_BYTES, LANGUAGES = 50_000, 200_000, 200
LANES = 4_096
SLICE_BYTES = 8_000_000
UNKNOWN = "und"
MISS = -(1 << 31)
#: Between sampled pieces, so that no match crosses them; no text has this byte.
CUT = 255


def cleaned(text: str = "text") -> F.Column:
    """Words of letters and marks in lower case between single blanks, a blank before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(common.text_or_empty(text)), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `data`, per state; 0 is the root."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in data:
        new, p = len(step), last
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Language:
    """One language's automaton as flat edges: state * 256 + byte, and the state it leads to."""

    def __init__(self, name: str, data: bytes):
        step = automaton(data)
        self.name, self.bits, self.states = name, float(np.log2(max(2, len(data)))), len(step)
        edges = sorted((s * 256 + c, t) for s, to in enumerate(step) for c, t in to.items() if c != CUT)
        self.edges = np.array([e for e, _ in edges], dtype=np.int64)
        self.to = np.array([t for _, t in edges], dtype=np.int32)


class Parser:
    """Dense tables of all languages: a cell holds the next cell row, with the sign bit set where a phrase ends before the byte."""

    def __init__(self, languages: list[Language]):
        self.names, self.bits = [x.name for x in languages], np.array([x.bits for x in languages])
        seen = np.unique(np.concatenate([x.edges % 256 for x in languages] or [np.zeros(0, np.int64)]))
        self.symbols = np.zeros(256, dtype=np.int64)
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        width, tables, self.roots, at = len(seen) + 1, [], [], 0
        for x in languages:
            root = np.full(width, at, dtype=np.int32)
            own = x.edges < 256
            root[self.symbols[x.edges[own] % 256]] = at + x.to[own].astype(np.int64) * width
            table = np.tile(root | np.int32(MISS), (x.states, 1))
            table[x.edges // 256, self.symbols[x.edges % 256]] = at + x.to.astype(np.int64) * width
            tables.append(table.reshape(-1))
            self.roots.append(at)
            at += len(tables[-1])
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, dtype=np.int64).reshape(-1, 1)

    def phrases(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text data[start:end] (rows) under each language (columns)."""
        parts = -(-(ends - starts) // PIECE)
        owner = np.repeat(np.arange(len(starts)), parts)
        first = starts[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(PIECE, ends[owner] - first)
        out = np.zeros((len(starts), len(self.names)), dtype=np.int64)
        symbols = self.symbols[data]
        order = np.argsort(-size, kind="stable")
        for s in range(0, len(order), LANES):
            lanes = order[s : s + LANES]
            at, left = first[lanes], size[lanes]
            state = np.repeat(self.roots, len(lanes), axis=1)
            count = np.zeros(state.shape, dtype=np.int64)
            active = np.searchsorted(-left, -np.arange(left[0]), side="left")
            for j, k in enumerate(active):
                to = self.table[state[:, :k] + symbols[at[:k] + j]]
                count[:, :k] += to < 0
                state[:, :k] = to & ~MISS
            np.add.at(out, owner[lanes], (count + (state != self.roots)).T)
        return out

    def judge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how far the next one is behind, as a share of its cost."""
        cost = self.phrases(data, starts, ends) * self.bits
        best = np.argmin(cost, axis=1)
        rows = np.arange(len(cost))
        least = cost[rows, best]
        cost[rows, best] = np.inf
        second = cost.min(axis=1)
        score = np.where(np.isinf(second), 1.0, (second - least) / np.where(np.isinf(second), 1.0, second))
        return [self.names[b] for b in best], score


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES, total_bytes: int = TOTAL_BYTES) -> list[Language]:
    """Learns from text and non-null lang of the documents that aren't held out; most frequent languages first."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(~held_out(F.col("doc_id"))).select("lang", "text")
    # copies count once: bytes of distinct texts, about
    stats = rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("distinct"), F.sum(F.octet_length("text")).alias("size")
    )
    known = stats.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not known:
        return []
    want = min(train_bytes, total_bytes // len(known))
    share = {r.lang: min(1.0, want / max(1.0, r["size"] * min(1.0, r.distinct / r.n))) for r in known}

    def sample(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            langs, pieces = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                data = text.as_buffer()
                limit = share.get(lang, -1.0) * 2.0**64
                for s in range(0, data.size, SAMPLE_PIECE):
                    piece = data.slice(s, min(SAMPLE_PIECE, data.size - s))
                    if xxhash.xxh3_64_intdigest(piece) < limit:
                        langs.append(lang)
                        pieces.append(piece.to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["lang", "piece"])

    def build(block):
        import pickle
        import zlib

        import pandas as pd
        import xxhash

        pieces = sorted(map(bytes, block["piece"]), key=xxhash.xxh3_64_intdigest)
        data = bytes([CUT]).join(pieces)[:want]
        return pd.DataFrame({"lang": [block["lang"].iloc[0]], "model": [zlib.compress(pickle.dumps(Language(block["lang"].iloc[0], data)))]})

    import pickle
    import zlib

    wide = rows.select("lang", F.encode(cleaned(), "UTF-8").alias("text"))
    pieces = wide.mapInArrow(common.tidy(sample), "lang string, piece binary").distinct()
    built = {r.lang: r.model for r in pieces.groupBy("lang").applyInPandas(build, "lang string, model binary").collect()}
    return [pickle.loads(zlib.decompress(built[r.lang])) for r in known if r.lang in built]


def identify(docs: DataFrame, languages: list[Language]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(languages)
    text = cleaned()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.when(text.rlike(r"\p{L}"), F.encode(text, "UTF-8")).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        parser = Parser(sent.value)
        for b in batches:
            texts = b.column("text")
            ends = np.cumsum([0, *(t.as_buffer().size if t.is_valid else 0 for t in texts)])
            s = 0
            while s < b.num_rows:
                # some rows of a bounded size at once, or one long one
                e = max(s + 1, int(np.searchsorted(ends, ends[s] + SLICE_BYTES, side="right")) - 1)
                part = [t.as_buffer() for t in texts.slice(s, e - s) if t.is_valid]
                data = np.frombuffer(b"".join(part), dtype=np.uint8)
                at = ends[s : e + 1] - ends[s]
                names, score = parser.judge(data, at[:-1], at[1:]) if parser.names else ([UNKNOWN] * (e - s), np.zeros(e - s))
                none = at[:-1] == at[1:]
                names = [UNKNOWN if x else n for n, x in zip(names, none)]
                columns = [b.column("doc_id").slice(s, e - s), b.column("held_out").slice(s, e - s), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])
                s = e

    return rows.mapInArrow(common.tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
