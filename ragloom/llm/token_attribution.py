"""Token counts with offset-mapped attribution.

A document's fields are joined to one record, which is encoded once, whole. A byte-level BPE loses nothing, so each token's
span in the record is the running sum of its tokens' byte lengths. Sections partition the record: each field other than the
text is one, each line of the text is one, and a separator belongs to the section before it. Token spans meet
section spans in an interval join of two sorted sequences (binary search).

A token that crosses boundaries goes whole to the section that holds most of its bytes, of equals to the first. So a
record's counts add up to the length of its encoding.

Defined results: null fields are empty sections (a null or empty text is one empty line); empty sections have no tokens of their own but for
their separator's; repeated rows are each counted; empty tables give empty results; columns that aren't asked for are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIELDS = ("source", "lang")
SEPARATOR = "\n"


class SpanEncoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset past each token."""
        return np.cumsum(self.length[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)])


def owners(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """Section of each token. Sections are [previous end, end) and cover all tokens; some may be empty."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    for t in np.flatnonzero(first != last).tolist():
        inner = section_ends[first[t] : last[t]]
        edges = np.concatenate([[starts[t]], inner, [token_ends[t]]])
        first[t] += int(np.argmax(np.diff(edges)))
    return first


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, SpanEncoder] = {}


def encoder(path: str) -> SpanEncoder:
    if path not in _encoders:
        _encoders[path] = SpanEncoder(path)
    return _encoders[path]


def sections(fields: list[str], text: str) -> tuple[str, list[str]]:
    """The record and its sections, each with its separator; the last line has none."""
    lines = text.split(SEPARATOR)
    parts = [f + SEPARATOR for f in fields] + [x + SEPARATOR for x in lines[:-1]] + [lines[-1]]
    return "".join(parts), parts


def count(docs: DataFrame, fields: tuple[str, ...] = FIELDS, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, section (from 0), field, start and end (characters in the record), n_tokens: one row per section."""
    spark = docs.sparkSession
    common.ship(spark)
    names = list(fields)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[common.text_or_empty(c).alias(f"f{i}") for i, c in enumerate([*names, text])])

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer or default_tokenizer())
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = part.column(0).to_pylist()
                columns = [part.column(i + 1).to_pylist() for i in range(len(names) + 1)]
                out = [[], [], [], [], [], []]
                for doc, *values in zip(ids, *columns):
                    record, parts = sections(values[:-1], values[-1])
                    n = len(parts)
                    ends = np.cumsum([len(p.encode()) for p in parts]) if not record.isascii() else np.cumsum([len(p) for p in parts])
                    tokens = enc.ends(record)
                    counts = np.bincount(owners(tokens, ends), minlength=n) if len(tokens) else np.zeros(n, dtype=np.int64)
                    chars = np.cumsum([len(p) for p in parts])
                    out[0] += [doc] * n
                    out[1].append(np.arange(n))
                    out[2] += names + [text] * (n - len(names))
                    out[3].append(np.concatenate([[0], chars[:-1]]))
                    out[4].append(chars)
                    out[5].append(counts)
                arrays = [pa.array(out[0], pa.int64()), pa.array(np.concatenate(out[1])), pa.array(out[2], pa.string())]
                arrays += [pa.array(np.concatenate(x).astype(np.int64)) for x in out[3:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "section", "field", "start", "end", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, section long, field string, start long, end long, n_tokens long")
