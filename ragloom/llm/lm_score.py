"""LM scoring with stupid backoff, by partitioned n-gram count tables.

Documents are scored by the n-gram counts of all *other* documents of the corpus, so that a document can't vouch for itself:
c(g) is the corpus count of n-gram g less its count in the document at hand. The word at place i, with up to N - 1 words
before it, scores c(longest seen n-gram) / c(its context), times ALPHA for each word of context that was given up; a word
that no other document has scores ALPHA / (words of the others + 1), times the same. A document's score is the sum of the logarithms.

Relations. A *block* is a bounded run of documents as columns of word hashes. For each order, blocks are exploded into
n-grams, (block, n-gram) pairs are counted within the block and partitioned by the n-gram's hash; a partition of all
blocks' pairs is the count table's partition, and joins back to the pairs, so each pair learns its corpus count. The counts
return to their block, where words are scored and summed per document. Pairs travel as packed columns, one row for each
block and partition, sorted by hash, so that the reply needs no keys. A frequent n-gram costs one pair per block, however many
documents have it. Orders run one after the other, and what the exchange of one wrote is freed before the next.

Words: A-Z lower-cased, split at white space 0x20 and 0x09 to 0x0D. N-grams are 64-bit hashes.

Defined results: null and empty texts have no words, a score of 0 and a null mean; repeated rows and doc_ids are documents of
their own; an only document has nothing but unseen words; a text of any length is one document of one block; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import pack, unpack

ORDER = 3
ALPHA = 0.4
BLOCK_WORDS = 1_500_000
#: Repeated n-grams of a block that are counted by document at once, documents whole.
OWN_AT_ONCE = 200_000
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _blocks(batches):
    """Documents to blocks: (block, doc_ids, lengths, types, words): `words` are indexes into the sorted `types`."""
    import pyarrow as pa

    memo: dict = {}
    names = ["block", "doc_ids", "lengths", "types", "words"]
    ids, lengths, parts, size = [], [], [], 0

    def close():
        types, words = np.unique(np.concatenate(parts), return_inverse=True)
        row = [[uuid.uuid4().hex], [list(ids)], [list(lengths)], [pack(types)], [pack(words.astype("<u4"))]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                h = common.word_hashes((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(), memo)
                ids.append(doc)
                lengths.append(len(h))
                parts.append(h)
                size += len(h)
                if size >= BLOCK_WORDS:
                    yield close()
                    ids, lengths, parts, size = [], [], [], 0
    if ids:
        yield close()


def grams(types: np.ndarray, words: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all n-grams that lie within a document."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.flatnonzero(np.arange(len(words)) + n <= ends)
    hashes = common.windows64(types[words], n)
    return starts, hashes[starts]


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack(row["types"], "<u8"), unpack(row["words"], "<u4"), np.array(row["lengths"], dtype=np.int64)


def _explode(n: int, buckets: int):
    """A block's distinct n-grams and their counts, cut into equal ranges of the hash."""

    def run(batches):
        import pyarrow as pa

        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
        for b in batches:
            for row in b.to_pylist():
                keys, counts = np.unique(grams(*_read(row), n)[1], return_counts=True)
                cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                out = [[], [], [], []]
                for k in range(buckets):
                    low, high = cut[k], cut[k + 1]
                    if low < high:
                        out[0].append(k)
                        out[1].append(row["block"])
                        out[2].append(pack(np.diff(keys[low:high], prepend=np.uint64(0))))
                        out[3].append(pack(counts[low:high].astype("<u4")))
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["bucket", "block", "keys", "counts"])

    return run


def _count(batches):
    """Rows sorted by bucket: the bucket's count table from all its pairs, joined back to them."""
    import pyarrow as pa

    at, held = None, []

    def close():
        keys = [np.cumsum(unpack(k, "<u8"), dtype=np.uint64) for _, k, _ in held]
        counts = np.concatenate([unpack(c, "<u4") for _, _, c in held])
        table, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(table))[place].astype("<i8")
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        replies = [pack(x) for x in np.split(total, sizes)]
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.array([b for b, _, _ in held]), pa.array(replies, pa.binary())], ["bucket", "block", "totals"])

    for b in batches:
        for i, (bucket, block) in enumerate(zip(b.column("bucket").to_pylist(), b.column("block").to_pylist())):
            if bucket != at:
                if held:
                    yield close()
                at, held = bucket, []
            held.append((block, b.column("keys")[i].as_py(), b.column("counts")[i].as_py()))
    if held:
        yield close()


def own_counts(place: np.ndarray, counts: np.ndarray, document: np.ndarray) -> np.ndarray:
    """How often each occurrence's n-gram stands in its own document; only n-grams that repeat in the block need a look. Documents
    come in ascending order and are counted some at a time."""
    own = np.ones(len(place), dtype=np.int64)
    again = np.flatnonzero(counts[place] > 1)
    owner, low = document[again], 0
    while low < len(again):
        high = np.searchsorted(owner, owner[min(low + OWN_AT_ONCE, len(owner)) - 1], side="right")
        part = again[low:high]
        key = place[part] * np.int64(owner[-1] + 1) + owner[low:high]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        own[part] = times[inverse]
        low = high
    return own


def score_block(row: dict, totals: Iterable[np.ndarray], corpus_words: int, alpha: float) -> dict[str, np.ndarray]:
    """Scores of a block's documents. `totals` has the corpus counts of the block's n-grams, order by order; they are taken one at a
    time, and what a longer n-gram says replaces what its suffix said, so that only two orders' counts are held."""
    types, words, lengths = _read(row)
    n_words = len(words)
    document = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    others = np.maximum(corpus_words - lengths, 0).astype(np.float64)
    log, level = np.zeros(n_words), np.zeros(n_words, dtype=np.int8)
    before, order = None, 0
    for n, total in enumerate(totals, 1):
        order = n
        starts, hashes = grams(types, words, lengths, n)
        c = np.zeros(n_words, dtype=np.int64)  # for each start, the n-gram's count in other documents
        if len(starts):
            _, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            del hashes
            c[starts] = total[place] - own_counts(place, counts, document[starts])
            del place, counts
        start = starts[c[starts] > 0]
        at = start + (n - 1)
        context = before[start] if n > 1 else others[document[at]]
        log[at] = np.log(c[start] / context)
        level[at] = n
        before = c
    most = np.minimum(np.arange(1, n_words + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths), order).astype(np.int8)
    new = level == 0
    log += (most - level) * np.log(alpha)
    log[new] -= np.log(others[document[new]] + 1)
    add = lambda w: np.bincount(document, weights=w, minlength=len(lengths))
    return {"n_words": lengths, "log_score": add(log), "n_backoff": add((level < most) & ~new), "n_unseen": add(new)}


def _score(order: int, corpus_words: int, alpha: float):
    """Rows sorted by (block, kind, bucket): a block (kind 0), then its replies of each order."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_words", "log_score", "n_backoff", "n_unseen"]
        row, replies = None, {}

        def close():
            none = [np.zeros(0, np.int64)]
            totals = (np.concatenate([unpack(x, "<i8") for x in replies.pop(n, [])] or none) for n in range(1, order + 1))
            out = score_block(row, totals, corpus_words, alpha)
            arrays = [pa.array(row["doc_ids"], pa.int64())] + [pa.array(out[k].astype(np.float64 if k == "log_score" else np.int64)) for k in names[1:]]
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            kinds = b.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if row is not None:
                        yield close()
                    row = b.slice(i, 1).to_pylist()[0]
                    replies = {}
                else:
                    replies.setdefault(kind, []).append(b.column("totals")[i].as_py())
        if row is not None:
            yield close()

    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score, mean_log, n_backoff, n_unseen of every document."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = docs.mapInArrow(common.tidy(_blocks), "block string, doc_ids array<long>, lengths array<long>, types binary, words binary")
    blocks = common.materialise(blocks, "blocks")
    corpus_words = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = buckets or common.parts_for(spark, corpus_words, BLOCK_WORDS)
    rows = blocks.selectExpr("block", "0 as kind", "0L as bucket", "doc_ids", "lengths", "types", "words", "cast(null as binary) as totals")
    for n in range(1, order + 1):
        pairs = blocks.drop("doc_ids").mapInArrow(common.tidy(_explode(n, buckets)), "bucket long, block string, keys binary, counts binary")
        pairs = pairs.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        replies = common.materialise(pairs.mapInArrow(common.tidy(_count), "bucket long, block string, totals binary"), f"counts{n}")
        nothing = "cast(null as array<long>)"
        rows = rows.union(
            replies.selectExpr("block", f"{n} as kind", "bucket", f"{nothing} as doc_ids", f"{nothing} as lengths", "cast(null as binary) as types", "cast(null as binary) as words", "totals")
        )
    dealt = rows.repartition(common.parts_for(spark, corpus_words, BLOCK_WORDS), "block").sortWithinPartitions("block", "kind", "bucket")
    out = dealt.mapInArrow(common.tidy(_score(order, corpus_words, alpha)), "doc_id long, n_words long, log_score double, n_backoff long, n_unseen long")
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log"), "n_backoff", "n_unseen")


def oracle_sql(order: int = ORDER, alpha: float = ALPHA) -> str:
    """DuckDB's SQL for `score` with joins on the words themselves (one row per doc_id)."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"with docs as (select doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') as w from documents)",
        "sizes as (select doc_id, len(w)::bigint as n, (sum(len(w)) over () - len(w))::bigint as others from docs)",
        "places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from docs)",
    ]
    for n in range(1, order + 1):
        parts.append(f"g{n} as (select doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') as g from places where i + {n - 1} <= len(w))")
        parts.append(f"c{n} as (select g, count(*) as c from g{n} group by g)")
        parts.append(f"o{n} as (select doc_id, g, count(*) as own from g{n} group by doc_id, g)")
        parts.append(f"l{n} as (select g{n}.doc_id, i, c - own as c from g{n} join c{n} using (g) join o{n} using (doc_id, g))")
    columns, joins = [], []
    for n in range(1, order + 1):
        joins.append(f"left join l{n} as e{n} on e{n}.doc_id = p.doc_id and e{n}.i = p.i - {n - 1}")
        columns.append(f"coalesce(e{n}.c, 0) as s{n}")
        if n > 1:
            joins.append(f"left join l{n - 1} as x{n} on x{n}.doc_id = p.doc_id and x{n}.i = p.i - {n - 1}")
            columns.append(f"coalesce(x{n}.c, 0) as x{n}")
    parts.append(f"p as (select doc_id, i, least(i, {order}) as most from places)")
    parts.append(f"s as (select p.doc_id, p.i, most, others, {', '.join(columns)} from p join sizes using (doc_id) {' '.join(joins)})")
    level = "case " + " ".join(f"when s{n} > 0 then {n}" for n in range(order, 0, -1)) + " else 0 end"
    parts.append(f"v as (select *, {level} as level from s)")
    value = "case " + " ".join(f"when level = {n} then ln(s{n}::double / {f'x{n}' if n > 1 else 'others'}) + (most - {n}) * ln({alpha})" for n in range(order, 0, -1))
    value += f" else most * ln({alpha}) - ln(others + 1) end"
    parts.append(
        f"t as (select doc_id, sum({value}) as score, sum((level < most and level > 0)::int)::bigint as b, sum((level = 0)::int)::bigint as u from v group by doc_id)"
    )
    return ",\n".join(parts) + (
        " select doc_id, n as n_words, round(coalesce(score, 0.0), 4) as log_score, round(score / n, 6) as mean_log, coalesce(b, 0) as n_backoff, coalesce(u, 0) as n_unseen"
        " from sizes left join t using (doc_id)"
    )
