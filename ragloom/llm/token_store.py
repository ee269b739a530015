"""Token-ID output with bit-plane shuffling, and its reader.

A *segment* is one byte string: it holds the ids of whole documents, cut into blocks of `BLOCK` ids. Each block's
little-endian 32-bit ids are transposed into planes (4 byte planes or 32 bit planes), each plane is compressed with
zstandard on its own, and a chunk index names each block's id count and each plane's offset and length:

    magic "RLTS" | version u8 | plane kind u8 (0 byte, 1 bit) | block ids u32 | documents u32 | blocks u32 | ids u64
    document table: doc_id i64[documents], n_tokens u64[documents]
    chunk index: per block n_ids u32, then (offset u64, length u32) of each plane, offsets from the data's start
    data: the compressed planes

Segments lie, in ascending doc_id order, as rows (shard, segment, first_id, payload) of a Parquet data set, which
Spark's committer writes to any file system: a lost executor's segments are written anew and never twice.

Defined results: a null text is an empty one (one end id); empty tables give an empty store; repeated doc_ids are all
kept, ordered by (doc_id, packed ids), a null doc_id counts as the lowest and is returned as null; texts of any length are
encoded whole; other columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from array import array

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC, HEAD = b"RLTS", struct.Struct("<4sBBIIIQ")
BYTE_PLANES, BIT_PLANES = 0, 1
BLOCK = 65_536
END_ID = 2
SEGMENT_IDS = 500_000
ROWS_PER_SHARD = 4_000
#: Text whose ids make a shuffle partition.
PARTITION_BYTES = 64_000_000
NULL_ID = -(2**63)
MARKS = ".,;:!?#$%&*+=@~^\"()[]{}/-"


def split_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of one block: byte plane k holds byte k of every id; bit plane k holds bit k, eight ids to a byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE_PLANES:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE_PLANES:
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def write_segment(doc_ids, lengths, ids: np.ndarray, kind: int = BYTE_PLANES, block: int = BLOCK, level: int = 1) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    index, data, at = [], [], 0
    starts = range(0, len(ids), block)
    for s in starts:
        part = ids[s : s + block]
        index.append(struct.pack("<I", len(part)))
        for plane in split_planes(part, kind):
            z = pack(plane)
            index.append(struct.pack("<QI", at, len(z)))
            data.append(z)
            at += len(z)
    head = HEAD.pack(MAGIC, 1, kind, block, len(doc_ids), len(starts), len(ids))
    table = np.asarray(doc_ids, dtype="<i8").tobytes() + np.asarray(lengths, dtype="<u8").tobytes()
    return b"".join([head, table, *index, *data])


class Segment:
    """Random access to a segment: any range of ids decodes only the blocks that hold it."""

    def __init__(self, payload: bytes):
        magic, version, self.kind, self.block, n_docs, self.n_blocks, self.n_ids = HEAD.unpack_from(payload)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        self.lengths = np.frombuffer(payload, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        self.planes = 4 if self.kind == BYTE_PLANES else 32
        self.entry = 4 + 12 * self.planes
        self.index_at = at + 16 * n_docs
        self.data_at = self.index_at + self.entry * self.n_blocks
        self.payload, self.unpack = payload, zstandard.ZstdDecompressor().decompress

    def read_block(self, b: int) -> np.ndarray:
        at = self.index_at + b * self.entry
        (n,) = struct.unpack_from("<I", self.payload, at)
        planes = []
        for k in range(self.planes):
            offset, length = struct.unpack_from("<QI", self.payload, at + 4 + 12 * k)
            planes.append(self.unpack(self.payload[self.data_at + offset : self.data_at + offset + length]))
        return join_planes(planes, n, self.kind)

    def read(self, first: int = 0, n: int | None = None) -> np.ndarray:
        last = self.n_ids if n is None else min(first + n, self.n_ids)
        if last <= first:
            return np.zeros(0, dtype="<u4")
        blocks = range(first // self.block, (last - 1) // self.block + 1)
        ids = np.concatenate([self.read_block(b) for b in blocks])
        return ids[first - blocks[0] * self.block : last - blocks[0] * self.block]


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stay, the others follow from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value


class WordEncoder:
    """Whole-text encoding with a tokenizers BPE that drops white space.

    Such a tokenizer's pieces never cross white space, so a text's ids are its chunks' ids in turn, and each distinct
    chunk goes through the tokenizer once while the bounded memo lasts. Plain Latin words, with or without marks after them, go straight to the
    library's BPE model (normalising and splitting can't alter them); any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.width = "<u2" if self.whole.get_vocab_size() <= 65_536 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        self.words = _Memo(self.word)
        self.chunks = _Memo(self.chunk)
        self.limit = limit
        self.letters = _byte_letters()
        self.odd_space = regex.compile(r"[\x1c-\x1f\x85]").search

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return self.pack([t.id for t in tokens])

    def chunk(self, w: str) -> bytes:
        low = w.lower()
        if low.isascii() or (max(low) < "ɐ" and unicodedata.is_normalized("NFC", w)):
            stem = low.rstrip(MARKS)
            if stem.isalpha():
                return self.words[stem] + self.words[low[len(stem) :]] if len(stem) < len(low) else self.words[stem]
        return self.pack(self.whole.encode(w, add_special_tokens=False).ids)

    def encode(self, text: str) -> np.ndarray:
        if self.odd_space(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.width)
        for memo in (self.chunks, self.words):
            if len(memo) > self.limit:
                memo.clear()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.split())), dtype=self.width)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str | None, end_id: int):
    def run(batches):
        import pyarrow as pa

        enc = encoder(path or default_tokenizer())
        for b in batches:
            texts = b.column("text")
            step = 256
            for s in range(0, b.num_rows, step):
                ids = [enc.encode(t) for t in texts.slice(s, step).to_pylist()]
                end = np.array([end_id], dtype=enc.width).tobytes()
                packed = [enc.width[2:].encode() + i.tobytes() + end for i in ids]
                part = b.slice(s, step)
                yield pa.RecordBatch.from_arrays(
                    [part.column("shard"), part.column("doc_id"), pa.array(packed, pa.binary())], ["shard", "doc_id", "ids"]
                )

    return run


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[:1].decode()}", offset=1).astype("<u4")


def _segments(kind: int, block: int, segment_ids: int):
    """Rows sorted by (shard, doc_id) to segments; a segment closes when it holds `segment_ids` ids or the shard ends."""

    def run(batches):
        import pyarrow as pa

        names = ["shard", "segment", "n_docs", "n_ids", "payload"]
        held, state = [], {"shard": None, "segment": 0, "n": 0}

        def close():
            ids = np.concatenate([x for _, x in held])
            payload = write_segment([d for d, _ in held], [len(x) for _, x in held], ids, kind, block)
            row = [[state["shard"]], [state["segment"]], [len(held)], [len(ids)], [payload]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            held.clear()
            state.update(segment=state["segment"] + 1, n=0)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)

        for b in batches:
            for shard, doc, packed in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
                if held and shard != state["shard"]:
                    yield close()
                if shard != state["shard"]:
                    state.update(shard=shard, segment=0)
                ids = _ids(packed.as_py())
                held.append((NULL_ID if doc is None else doc, ids))
                state["n"] += len(ids)
                if state["n"] >= segment_ids:
                    yield close()
        if held:
            yield close()

    return run


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, planes: int = BYTE_PLANES,
          block: int = BLOCK, segment_ids: int = SEGMENT_IDS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Encode `docs` (doc_id, text), write them as a token store at `path` (default: the shared folder), and return the
    store's segments as a DataFrame that reads those files."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    encoded = common.with_range(docs, "doc_id", "shard", n, rows_per_shard).select("shard", "doc_id", "text").mapInArrow(common.tidy(_encode(tokenizer, end_id)), "shard long, doc_id long, ids binary")
    dealt = encoded.repartition(common.parts_for(spark, size or 0, PARTITION_BYTES), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    out = dealt.mapInArrow(common.tidy(_segments(planes, block, segment_ids)), "shard long, segment long, n_docs long, n_ids long, payload binary")
    if path is None:
        return common.materialise(out, "tokens")
    out.write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def _read_back(batches):
    import pyarrow as pa

    for b in batches:
        for shard, segment, payload in zip(b.column("shard").to_pylist(), b.column("segment").to_pylist(), b.column("payload")):
            s = Segment(payload.as_py())
            ends = np.cumsum(s.lengths)
            raw = memoryview(s.read().astype("<u4").tobytes())
            starts = ends - s.lengths
            crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard)), pa.array(np.full(n, segment)), pa.array(s.doc_ids.astype(np.int64), mask=s.doc_ids == NULL_ID),
                    pa.array(starts), pa.array(s.lengths), pa.array(crc, pa.int64()),
                ],
                ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def documents_of(store: DataFrame) -> DataFrame:
    """Decode every segment of a store: doc_id, start, n_tokens, ids_crc32, shard, segment.

    `start` needs the ids before each segment. Segments are summed per shard, shards over shards: a shard has a few
    segments, and there is one row per shard, some thousands of documents, in the one ordered sum over all of them,
    which runs over ranges of shards."""
    common.ship(store.sparkSession)
    sizes = store.select("shard", "segment", "n_ids")
    inside = "sum(n_ids) over (partition by shard order by segment rows between unbounded preceding and 1 preceding)"
    in_shard = sizes.selectExpr("shard", "segment", f"coalesce({inside}, 0) as before")
    per_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    group = per_shard.withColumn("span", F.floor(F.col("shard") / 256))
    spans = group.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.selectExpr("span", "coalesce(sum(n) over (order by span rows between unbounded preceding and 1 preceding), 0) as lead")
    run = "sum(n) over (partition by span order by shard rows between unbounded preceding and 1 preceding)"
    starts = group.selectExpr("shard", "span", f"coalesce({run}, 0) as within").join(spans, "span").selectExpr("shard", "lead + within as lead")
    begin = in_shard.join(starts, "shard").selectExpr("shard", "segment", "lead + before as first_id")
    docs = store.mapInArrow(common.tidy(_read_back), "shard long, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(begin, ["shard", "segment"]).selectExpr(
        "doc_id", "cast(first_id + inside as long) as start", "n_tokens", "ids_crc32", "shard", "segment"
    )
