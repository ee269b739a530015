"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a bounded block of documents. Its words become symbols: words that occur in no benchmark window are one
foreign symbol and only maximal runs of window words, as long as the shortest window at least, enter the index; no
occurrence of any window can cross a foreign word, so nothing is lost. Over these runs the shard gets a suffix array, its
Burrows-Wheeler transform, a wavelet tree that answers rank queries in one step per bit of a symbol, and suffix
positions sampled at every eighth place. All windows are searched backwards at once; the occurrences of what is found
are located by walking to the next sampled position, and merged into the documents' removal spans.

Words, as the contract has them: A-Z lower-cased, then maximal runs of characters other than
\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F. A window is `n` consecutive item words; an item of fewer words is one window.

Defined results: a null or empty text has no words, is clean and kept as it is; an item without words has no window; equal items both
count; repeated rows are each searched; a text of any length is searched whole, as a block of its own; empty tables give empty
results; other columns are carried along in `remove`.

Memory: a worker holds one block of documents and one pass of the benchmark, PASS_BYTES of text and its windows (about
nine bytes for each byte of text); the driver holds a pass's texts while it sends them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 10
SAMPLE = 8
BLOCK_BYTES = 8_000_000
#: Benchmark text that one pass carries to every task; a larger benchmark is searched in as many passes as it needs.
PASS_BYTES = 8_000_000

_KEPT = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A-Z to a-z, any byte outside words to a blank; UTF-8's bytes of other characters are all above 0x7F and stay.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b in _KEPT or 0x41 <= b <= 0x5A) else 0x20 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; `s` ends with a symbol that is smaller than all others."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
        if k >= n:
            return order


class WaveletTree:
    """A wavelet tree level by level (a wavelet matrix): bits of each level from the highest, and their prefix counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        s = symbols
        for level in range(bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before `position`, for arrays of both."""
        start, end = np.zeros_like(position), position
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one, ones = ((symbol >> level) & 1).astype(bool), self.ones[i]
            a, b = ones[start], ones[end]
            start = np.where(one, self.zeros[i] + a, start - a)
            end = np.where(one, self.zeros[i] + b, end - b)
        return end - start

    def access(self, position: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(position)
        for i in range(self.bits):
            ones = self.ones[i]
            a = ones[position]
            one = ones[position + 1] - a
            symbol = 2 * symbol + one
            position = np.where(one == 1, self.zeros[i] + a, position - a)
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        """`text`: symbols 1..sigma-1; symbol 0 ends it."""
        s = np.append(text, 0).astype(np.int64)
        order = suffix_array(s)
        bwt = s[order - 1]
        self.n, self.sigma = len(s), sigma
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma + 1))]).astype(np.int64)
        self.tree = WaveletTree(bwt, max(1, int(sigma).bit_length()))
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)]).astype(np.int64)
        self.places = order[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of all patterns (rows of `patterns`, left-aligned) by backward search."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back until a sampled one."""
        out, at, steps = np.full(len(rows), -1, dtype=np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            known = self.marked[at[live]]
            done = live[known]
            out[done] = self.places[self.mark_rank[at[done]]] + steps
            live = live[~known]
            if len(live):
                c = self.tree.access(at[live])
                at[live] = self.first[c] + self.tree.rank(c, at[live])
            steps += 1
        return out


class Windows:
    """The distinct windows of benchmark items as rows of symbols, and the items of each: `items[i]` for i in
    `holders[first[w] : first[w + 1]]`. Symbols 0 and 1 end a text and stand for words that no item has."""

    def __init__(self, items: list[tuple], n: int = N):
        vocabulary: dict[bytes, int] = {}
        get = vocabulary.setdefault
        texts = [np.array([get(x, len(vocabulary) + 2) for x in words(text)], dtype=np.int32) for _, text in items]
        self.vocabulary, self.sigma = vocabulary, len(vocabulary) + 2
        names = [str(item) for item, _ in items]
        self.items, holder = np.unique(names, return_inverse=True) if names else (np.zeros(0, "U1"), np.zeros(0, np.int64))
        counts = np.array([max(1, len(w) - n + 1) if len(w) else 0 for w in texts], dtype=np.int64)
        rows = np.zeros((int(counts.sum()), n), dtype=np.int32)
        at = 0
        for w, c in zip(texts, counts.tolist()):
            if len(w) >= n:
                rows[at : at + c] = np.lib.stride_tricks.sliding_window_view(w, n)
            elif c:
                rows[at, : len(w)] = w
            at += c
        owner = np.repeat(np.asarray(holder, dtype=np.int64), counts)
        order = np.lexsort((owner, *rows.T)) if len(rows) else np.zeros(0, np.int64)
        rows, owner = rows[order], owner[order]
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
        again = ~fresh
        again[1:] &= owner[1:] == owner[:-1]
        self.rows = rows[fresh]
        self.holders = owner[~again].astype(np.int32)
        self.first = np.append(np.flatnonzero(fresh[~again]), len(self.holders))
        self.lengths = (self.rows > 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=n))

    def items_of(self, windows: np.ndarray) -> list[str]:
        held = [self.holders[self.first[w] : self.first[w + 1]] for w in windows.tolist()]
        return self.items[np.unique(np.concatenate(held))].tolist()


def find(texts: list[bytes], windows: Windows) -> list[tuple[int, np.ndarray, list[str]]]:
    """For folded texts: number of words, hit words' indexes, items with occurring windows."""
    get = windows.vocabulary.get
    symbols, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        lengths[i] = len(w)
        symbols.append(np.array([get(x, 1) for x in w], dtype=np.int64))
        symbols.append(np.ones(1, dtype=np.int64))
    found: list[tuple[int, np.ndarray, list[str]]] = [(int(n), np.zeros(0, dtype=np.int64), []) for n in lengths]
    if not symbols or not len(windows.rows):
        return found
    flat = np.concatenate(symbols)
    known = flat > 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= windows.shortest
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return found
    sizes = ends - starts + 1  # with one foreign symbol after each run
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    index = FMIndex(flat[at], windows.sigma)
    low, high = index.search(windows.rows, windows.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return found
    times = high[hit] - low[hit]
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    which = np.repeat(hit, times)
    place = at[index.locate(rows)]
    cover = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + windows.lengths[which], -1)
    covered = np.cumsum(cover[:-1]) > 0
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    document = np.searchsorted(begins, place, side="right") - 1
    pairs = np.unique(np.stack([document, which], axis=1), axis=0)
    hit_documents, first = np.unique(pairs[:, 0], return_index=True)
    for d, own in zip(hit_documents.tolist(), np.split(pairs[:, 1], first[1:])):
        span = covered[begins[d] : begins[d] + lengths[d]]
        found[d] = (int(lengths[d]), np.flatnonzero(span), windows.items_of(own))
    return found


def spans(hits: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, past) of hit word indexes."""
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) > 1)
    return list(zip(hits[np.concatenate([[0], cut + 1])].tolist(), (hits[np.concatenate([cut, [len(hits) - 1]])] + 1).tolist()))


def _blocks(texts, limit: int):
    """(first row, folded texts) of bounded blocks; a longer text is a block of its own."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        folded = (t.as_py() or "").encode("utf-8", "surrogatepass").translate(FOLD)
        if held and size + len(folded) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(folded)
        size += len(folded)
    if held:
        yield first, held


def passes(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item, text) of the benchmark, and in how many passes of at most PASS_BYTES of text (or one longer item) it goes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    return items, max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))


def _pass(items: DataFrame, p: int, parts: int):
    """One pass's items, for tasks: texts travel, windows are built there."""
    part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).collect()
    return items.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in part])


_built: dict = {}


def _windows(sent, n: int) -> Windows:
    """The windows of a pass, built once per Python worker; it holds one pass at a time."""
    key = (sent._path, n)
    if key not in _built:
        _built.clear()
        _built[key] = Windows(sent.value, n)
    return _built[key]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged [first, past) word ranges to remove), items (sorted strings).

    Map-only where the benchmark goes in one pass. Else each pass is a job of its own that writes what it found, by doc_id
    and the text's hash, and the passes' spans are merged in the end."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    items, parts = passes(benchmark)
    if parts == 1:
        return docs.mapInArrow(_scan(_pass(items, 0, 1), n), FOUND).drop("h")
    first, hits = _in_turn(docs, items, parts, n)
    joined = first.join(hits, F.expr("doc_id <=> d and h = g"), "left")
    return joined.selectExpr("doc_id", "n_words", "coalesce(spans, array()) as spans", "coalesce(items, array()) as items")


def _in_turn(docs: DataFrame, items: DataFrame, parts: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_words) of all rows, and (d, g, spans, items) of what all passes hit, by doc_id and the text's hash."""
    every = []
    for p in range(parts):
        sent = _pass(items, p, parts)
        found = docs.mapInArrow(_scan(sent, n), FOUND)
        every.append(common.materialise(found if p == 0 else found.where("size(spans) > 0"), f"pass{p}"))
        sent.destroy()
    hits = every[0].where("size(spans) > 0")
    for other in every[1:]:
        hits = hits.union(other)
    hits = hits.selectExpr("doc_id as d", "h as g", "spans", "items").distinct().groupBy("d", "g")
    hits = hits.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return every[0].select("doc_id", "h", "n_words"), hits.select("d", "g", _merged("spans").alias("spans"), "items")


FOUND = "doc_id long, h long, n_words long, spans array<array<long>>, items array<string>"


def _merged(spans: str):
    """Overlapping and touching spans of several passes as one."""

    def step(out, s):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))[1] >= s[0]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<array<bigint>>)"), step)


def _scan(sent, n: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, texts in _blocks(b.column("text"), BLOCK_BYTES):
                found = find(texts, _windows(sent, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(first, len(texts)),
                        b.column("h").slice(first, len(texts)),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([[list(x) for x in spans(f[1])] for f in found], pa.list_(pa.list_(pa.int64()))),
                        pa.array([f[2] for f in found], pa.list_(pa.string())),
                    ],
                    ["doc_id", "h", "n_words", "spans", "items"],
                )

    return run


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `scan`'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without(text: str, hit: list[tuple[int, int]]) -> str:
    """`text` without its hit words: each span goes, from its first word's first character to its last word's last, and
    a line break takes its place."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, last = [], 0
    for a, b in hit:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    out.append(raw[last:])
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def cut(text: str, windows: Windows) -> str:
    """`text` without its hit words, repeated until no window occurs, as cutting can bring words together."""
    while len(hits := find([text.encode("utf-8", "surrogatepass").translate(FOLD)], windows)[0][1]):
        text = without(text, spans(hits))
    return text


def _remove(sent, n: int, text: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index(text)
            column = b.column(at)
            for first, texts in _blocks(column, BLOCK_BYTES):
                own = _windows(sent, n)
                found = find(texts, own)
                part, old = b.slice(first, len(texts)), column.slice(first, len(texts)).to_pylist()
                new = [cut(t, own) if len(f[1]) else t for t, f in zip(old, found)]
                part = part.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
                yield part.filter(pa.array([n is o or bool(n.strip()) for n, o in zip(new, old)], pa.bool_()))

    return run


def _without(text: str, names: list[str]):
    """Rows (names, then their spans) without what lies in their spans."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            new = [without(t, s) for t, s in zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(len(names)).to_pylist())]
            at = names.index(text)
            part = b.select(range(len(names))).set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield part.filter(pa.array([bool(t.strip()) for t in new], pa.bool_()))

    return run


def remove(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """`docs` with every benchmark window cut out of `text`; clean rows stay as they are, and rows of which nothing but
    white space is left go. All columns are kept. With several passes, rows are cut by all passes' spans at once, and
    what was cut is searched again until nothing is found, as within one pass."""
    common.ship(docs.sparkSession)
    items, parts = passes(benchmark)
    if parts == 1:
        return common.map_rows(docs, _remove(_pass(items, 0, 1), n, text))
    words = F.col(common.quoted(text))
    length, h = F.octet_length(words).cast("long"), F.xxhash64(words.cast("string"))
    d, g, spans = common.free_names(docs, "d", "g", "spans")
    clean, rest = None, docs
    while True:
        keyed = rest.where(words.isNotNull()).select(length.alias("doc_id"), h.alias("h"), words.cast("string").alias("text"))
        hits = common.materialise(_in_turn(keyed, items, parts, n)[1].selectExpr(f"d as {d}", f"g as {g}", f"spans as {spans}"), "hits")
        same = (length == F.col(d)) & (h == F.col(g))
        left = rest.join(hits, same, "left_anti")
        clean = left if clean is None else clean.union(left)
        if not hits.limit(1).count():
            return clean
        hit = rest.join(hits, same).select(*map(common.quoted, docs.columns), spans)
        rest = common.materialise(common.map_rows(hit, _without(text, docs.columns), docs.columns), "cut")
