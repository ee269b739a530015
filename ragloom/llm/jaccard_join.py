"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the classes its links make.

Sets. A document's set holds the 64-bit hashes of its distinct five-word shingles. Equal sets are one node from here on.

Inverted lists. All sets order their shingles by hash. A set of n shingles is found through its *own* lists, its first
p = n - ceil(0.8 n) + 1: two sets that reach the threshold share one of these at least. The index also holds every
shingle under a fixed share of the hash range, so that a query's own lists are nearly always known in full.

T-occurrence. A query asks for partners that are no smaller than itself. Such a partner must occur in
T = ceil(8 n / 9) - (n - p) - u of the query's own lists (u: those that the index might lack for a partner). Lists with
more than LONG entries are long; DivideSkip leaves out the T - 1 longest of them at most, as a partner must
then still be in T less as many of the others, so in one of the rarest lists, all but that number less 1. Size classes keep
out sets that no query could reach. So passages that many documents share cost nothing, unless a query consists
of so much of them that long lists are left (it is *heavy*; whatever it could reach is *near*).

Exchange. Lists are never rows. A block is a bounded run of sets with their shingles; it sends its distinct shingles, sorted and
packed, to ranges of the hash, and each range answers how many sets have them, and in a second turn which sizes are
asked for. A frequent shingle costs one entry per block, however many documents have it. Ranges are cut at the
entries' own quantiles, so each holds RANGE of them at most, and the little by which hashes stray from even.

Three searches with the same code. First, all sets: it leaves the candidates, whose texts are shingled again. These go to the
block of their most popular list; large blocks are dealt into sub-blocks several times, each time by another hash and with a leader
that all share, and each sub-block runs the whole search inside: merging its short lists, probing the long ones in
each candidate's sorted shingles, which gives exact intersections. The classes found so absorb large groups in time
linear in their size. Second, the candidates again, by lists whose members are of different classes only. Third, what is heavy
or near even so, by all shingles: there T is ceil(8 n / 9) of n lists, and only the n - T + 1 rarest are asked. In
the end a query visits each cell (a sub-block of one deal) where enough of its lists have members of other classes,
and is searched there as before. So rows move per query and cell and not per pair. No link between classes is lost.

Defined results: null or empty texts, or texts of white space, have an empty set and are linked with nothing; texts under five words
have one shingle, the whole sequence; repeated rows and doc_ids are kept row by row; a null doc_id counts as the
lowest; pairs at exactly 0.8 are linked; texts of any length are taken whole; empty tables give empty results; other columns
are carried along in `keep_one`.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
LONG = 100
SUB_BLOCK = 192
#: How often a large block is dealt; a node meets some TURNS * SUB_BLOCK others of its block.
TURNS = 3
INDEX_SHARE = 0.22
#: Partners' sizes differ by 1.25 times at most, so by one class of this ratio.
CLASS = 1.26
#: Entries (sets times shingles) of a block, and of a range of the hash.
BLOCK = 1_000_000
RANGE = 1_500_000
#: Equal parts of the hash in which entries are counted to place the ranges' bounds.
SLOT_BITS = 12
SLOTS = 1 << SLOT_BITS
NULL_ID = -(2**63)
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(text: str | None, memo: dict) -> np.ndarray:
    """Sorted distinct shingle hashes. `bytes.split` splits at the contract's white space, 0x20 and 0x09 to 0x0D."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(common.windows64(common.word_hashes(w, memo), min(WORDS, len(w))))


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def required(n: int, m: int) -> int:
    """Least intersection of sets of n and m that links: 100 i >= 80 (n + m - i)."""
    return -(-4 * (n + m) // 9)


def _set_id(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _sketch(batches):
    """Per row: set_id, n, T and, for the first row of a set in a task, its own and its other indexed shingles."""
    import pyarrow as pa

    memo, seen = {}, set()
    limit = np.uint64(int(INDEX_SHARE * 2**64))
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            ids, sizes, least, own, other = [], [], [], [], []
            for t in part.column("text").to_pylist():
                x = shingles(t, memo)
                n = len(x)
                i = _set_id(x) if n else 0
                p = prefix(n) if n else 0
                under = int(np.searchsorted(x, limit, side="right"))
                ids.append(i)
                sizes.append(n)
                least.append(max(1, required(n, n) - (n - p) - (p - min(p, under))))
                known = n == 0 or i in seen
                own.append(None if known else x[:p].tobytes())
                other.append(None if known else x[p:under].tobytes())
                seen.add(i)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("h"), *(pa.array(v, pa.int64()) for v in (ids, sizes, least)), *(pa.array(v, pa.binary()) for v in (own, other))],
                ["id", "h", "set_id", "n", "t", "own", "other"],
            )


def _add_shingles(batches):
    """The column `text` becomes `shingles`; rows whose text makes another set than `set_id` go."""
    import pyarrow as pa

    memo = {}
    for b in batches:
        names = [k for k in b.schema.names if k != "text"]
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            sets = [shingles(t, memo) for t in part.column("text").to_pylist()]
            keep = [len(x) > 0 and _set_id(x) == i for x, i in zip(sets, part.column("set_id").to_pylist())]
            rows = [*map(part.column, names), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, [*names, "shingles"]).filter(pa.array(keep, pa.bool_()))


# --- the exchange: blocks of sets, ranges of the hash -----------------------------------------------------------------

SET = ("set_id", "id", "h", "n", "t", "root", "asks", "least")
BLOCKS = "block long, kind int, bucket long, body binary"
PAIRS = "bucket long, block long, keys binary, first binary, second binary"


def _rows(columns: dict, schema: str):
    """A batch of the flat `schema` (as for mapInArrow) from lists."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[t]) for k, t in fields], [k for k, _ in fields])


def _to_blocks(batches):
    """Rows sorted by set_id to blocks; equal sets become one. A block is named after its first set."""
    held, last, size = [], None, 0

    def close():
        body = {k: np.array([r[i] for r in held], dtype=np.int64) for i, k in enumerate(SET)}
        own, other = ([np.frombuffer(r[i], dtype=np.uint64) for r in held] for i in (-2, -1))
        body["own"] = np.array([len(x) for x in own], dtype=np.int64)
        body["lists"] = body["own"] + np.array([len(x) for x in other], dtype=np.int64)
        body["keys"] = np.concatenate([x for pair in zip(own, other) for x in pair])
        return _rows({"block": [held[0][0]], "kind": [0], "bucket": [0], "body": [pickle.dumps(body)]}, BLOCKS)

    for b in batches:
        for s in range(0, b.num_rows, 1024):
            part = b.slice(s, 1024)
            for r in zip(*(part.column(k).to_pylist() for k in (*SET, "own", "other"))):
                if r[0] == last:
                    continue
                last = r[0]
                held.append(r)
                size += (len(r[-2]) + len(r[-1])) // 8
                if size >= BLOCK:
                    yield close()
                    held, size = [], 0
    if held:
        yield close()


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, distinct) of keys sorted."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, starts, sorted_keys[starts]


def _each(group: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`values` (one for each run that begins at `starts` of the order `group`) for each entry."""
    out = np.empty(len(group), dtype=values.dtype)
    out[group] = np.repeat(values, np.diff(np.append(starts, len(group))))
    return out


def _count_slots(batches):
    """Entries of `own` and `other` in each of the hash's SLOTS equal parts."""
    import pyarrow as pa

    total = np.zeros(SLOTS, dtype=np.int64)
    for b in batches:
        for k in ("own", "other"):
            for data in b.column(k):
                if data.is_valid:
                    keys = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                    total += np.bincount((keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])


def _edges(sets: DataFrame, buckets: int) -> np.ndarray:
    """Bounds of `buckets` ranges of the hash that hold equally many of the sets' entries: own lists are the sets' smallest
    hashes, so equal widths would not. Within a slot hashes are uniform; the driver gets one number per slot."""
    counted = sets.select("own", "other").mapInArrow(common.tidy(_count_slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    n = np.zeros(SLOTS)
    for r in counted.collect():
        n[r.slot] = r.n
    below = np.concatenate([[0.0], np.cumsum(n)])
    at = np.interp(below[-1] * np.arange(1, buckets) / buckets, below, np.arange(SLOTS + 1.0)) if below[-1] else SLOTS * np.arange(1, buckets) / buckets
    return (at * 2.0 ** (64 - SLOT_BITS)).astype(np.uint64)


def _cut(block: int, distinct: np.ndarray, first: np.ndarray, second: np.ndarray | None, edges: np.ndarray):
    """A block's entries, cut into the ranges of the hash that `edges` bound."""
    cut = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
    out = {k: [] for k in ("bucket", "block", "keys", "first", "second")}
    for k in np.flatnonzero(np.diff(cut)).tolist():
        low, high = cut[k], cut[k + 1]
        out["bucket"].append(k)
        out["block"].append(block)
        out["keys"].append(common.pack(np.diff(distinct[low:high], prepend=np.uint64(0))))
        out["first"].append(common.pack(first[low:high]))
        out["second"].append(None if second is None else common.pack(second[low:high]))
    return _rows(out, PAIRS)


def _bodies(batches):
    for b in batches:
        for block, body in zip(b.column("block").to_pylist(), b.column("body")):
            yield block, pickle.loads(body.as_py())


MIXED = np.uint32(1 << 31)


def _send_counts(edges: np.ndarray):
    """Per distinct shingle of a block: how many sets have it (top bit: sets of different classes), and a class."""

    def run(batches):
        for block, x in _bodies(batches):
            order, starts, distinct = _grouped(x["keys"])
            if not len(distinct):
                continue
            count = np.diff(np.append(starts, len(order))).astype(np.uint32)
            root = np.repeat(x["root"], x["lists"])[order]
            low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
            yield _cut(block, distinct, count | np.where(low != high, MIXED, np.uint32(0)), low, edges)

    return run


def _send_single(edges: np.ndarray):
    """As `_send_counts` where every set is a class of its own: no classes travel."""

    def run(batches):
        for block, x in _bodies(batches):
            order, starts, distinct = _grouped(x["keys"])
            if len(distinct):
                yield _cut(block, distinct, np.diff(np.append(starts, len(order))).astype(np.uint32), None, edges)

    return run


def _by_bucket(batches, answer):
    """Rows sorted by bucket: `answer`(keys, first, second of all blocks) gives what returns to the blocks."""
    at, held = None, []

    def close():
        keys = [np.cumsum(common.unpack(k, "<u8"), dtype=np.uint64) for _, k, _, _ in held]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        replies = np.split(answer(np.concatenate(keys), [f for _, _, f, _ in held], [s for _, _, _, s in held]), cuts)
        return _rows({"block": [b for b, *_ in held], "kind": [1] * len(held), "bucket": [at] * len(held), "body": [common.pack(r) for r in replies]}, BLOCKS)

    for b in batches:
        data = [b.column(k) for k in ("keys", "first", "second")]
        for i, (bucket, block) in enumerate(zip(b.column("bucket").to_pylist(), b.column("block").to_pylist())):
            if bucket != at:
                if held:
                    yield close()
                at, held = bucket, []
            held.append((block, *(d[i].as_py() for d in data)))
    if held:
        yield close()


def _counts(batches):
    """The length of each list whose members are of different classes, 0 for others."""

    def answer(keys, first, second):
        told = np.concatenate([common.unpack(f, "<u4") for f in first])
        order, starts, _ = _grouped(keys)
        count = np.add.reduceat((told & ~MIXED)[order].astype(np.int64), starts)
        if second[0] is None:
            mixed = count > 1
        else:
            root = np.concatenate([common.unpack(s, "<i8") for s in second])[order]
            mixed = (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)) | (np.maximum.reduceat(told[order], starts) >= MIXED)
        return _each(order, np.where(mixed, np.minimum(count, 2**32 - 1), 0).astype("<u4"), starts)

    yield from _by_bucket(batches, answer)


def _wishes(batches):
    """All blocks' wishes for each list together: sizes that light and that heavy queries ask for."""

    def answer(keys, first, second):
        order, starts, _ = _grouped(keys)
        both = [np.bitwise_or.reduceat(np.concatenate([common.unpack(x, "<u8") for x in part])[order], starts) for part in (first, second)]
        return np.stack([_each(order, m, starts) for m in both], axis=1).view("V16").reshape(-1)

    yield from _by_bucket(batches, answer)


def _with_replies(batches, close):
    """Rows sorted by (block, kind, bucket): `close`(block, body, replies in the order of the hash) for each block."""
    at, body, replies = None, None, []
    for b in batches:
        data = b.column("body")
        for i, (block, kind) in enumerate(zip(b.column("block").to_pylist(), b.column("kind").to_pylist())):
            if kind == 0:
                if body is not None:
                    yield close(at, body, replies)
                at, body, replies = block, pickle.loads(data[i].as_py()), []
            else:
                replies.append(data[i].as_py())
    if body is not None:
        yield close(at, body, replies)


SHORT, RAREST = 1, 2


def _plan(long: int | None):
    """Each set's T-occurrence plan from its lists' lengths: which are skipped, short and rarest, and how many of the short
    ones a partner needs. `long`: lists beyond it may be skipped and make a query heavy; None: any may, and none does."""

    def close(block, x, replies):
        order, starts, distinct = _grouped(x["keys"])
        df = np.concatenate([common.unpack(r, "<u4") for r in replies]) if replies else np.zeros(0, np.uint32)
        df = _each(order, df, starts).astype(np.int64)
        owner = np.repeat(np.arange(len(x["n"])), x["lists"])
        place = np.arange(len(df)) - np.repeat(np.cumsum(x["lists"]) - x["lists"], x["lists"])
        alive = np.bincount(owner, weights=df > 0, minlength=len(x["n"])) >= x["least"]
        keep = (df > 0) & alive[owner]
        own, keys, df, owner = (place < x["own"][owner])[keep], x["keys"][keep], df[keep], owner[keep]
        sets = len(x["n"])
        have = np.bincount(owner, weights=own, minlength=sets).astype(np.int64)
        lengthy = np.bincount(owner, weights=own & (df > (long or 0)), minlength=sets).astype(np.int64)
        query = (x["asks"] > 0) & (have >= x["t"])
        skipped = np.minimum(x["t"] - 1, lengthy)
        heavy = query & (lengthy > skipped) if long is not None else np.zeros(sets, bool)
        at = np.flatnonzero(own & query[owner])
        at = at[np.lexsort((keys[at], -df[at], owner[at]))]
        mine = owner[at]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(at) else np.zeros(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        role = np.zeros(len(keys), dtype=np.uint8)
        role[at] = np.where(rank >= skipped[mine], SHORT, 0) | np.where(rank >= x["t"][mine] - 1, RAREST, 0)
        held = np.flatnonzero(np.bincount(owner, minlength=sets))
        number = np.full(sets, -1)
        number[held] = np.arange(len(held))
        out = {k: x[k][held] for k in SET} | {"light": (query & ~heavy)[held], "heavy": heavy[held], "need": (x["t"] - skipped)[held]}
        out |= {"owner": number[owner], "keys": keys, "df": df, "mine": own, "role": role}
        return _rows({"block": [block], "kind": [0], "bucket": [0], "body": [pickle.dumps(out)]}, BLOCKS)

    return lambda batches: _with_replies(batches, close)


ANY = np.uint64(1 << 63)


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(n) / np.log(CLASS)), 60).astype(np.uint64)


def _send_wishes(edges: np.ndarray):
    """Per distinct shingle of a block: size classes that its light and its heavy queries ask for among the rarest lists, and
    whether it is a short list of a light query at all."""

    def run(batches):
        for block, x in _bodies(batches):
            order, starts, distinct = _grouped(x["keys"])
            if not len(distinct):
                continue
            c = _size_class(x["n"])[x["owner"]]
            wish = np.where(x["role"] & RAREST > 0, (np.uint64(1) << c) | (np.uint64(2) << c), np.uint64(0))
            light, heavy = x["light"][x["owner"]], x["heavy"][x["owner"]]
            any_ = np.where(x["role"] & SHORT > 0, ANY, np.uint64(0))
            masks = [np.bitwise_or.reduceat(m[order], starts) for m in (np.where(light, wish | any_, np.uint64(0)), np.where(heavy, wish, np.uint64(0)))]
            yield _cut(block, distinct, *masks, edges)

    return run


FOUND = "set_id long, id long, h long, n long, t long, root long, need long, light boolean, heavy boolean, near boolean, involved boolean, block long, own binary, other binary, short array<long>"


def _reached(final: bool):
    """Queries and whatever they reach. `own`, `other`: shingles in lists that count; `final`: in `own`, those that light queries ask."""

    def close(block, x, replies):
        order, starts, _ = _grouped(x["keys"])
        told = np.concatenate([common.unpack(r, "V16") for r in replies]) if replies else np.zeros(0, "V16")
        told = _each(order, told, starts).view(np.uint64).reshape(-1, 2)
        sets = len(x["n"])
        c = _size_class(x["n"])[x["owner"]]
        hit = [np.bincount(x["owner"], weights=(told[:, k] >> c) & np.uint64(1), minlength=sets) > 0 for k in (0, 1)]
        involved, near = x["light"] | hit[0], x["heavy"] | hit[1]
        out = {k: [] for k in (f.strip().split(" ")[0] for f in FOUND.split(","))}
        ends = np.searchsorted(x["owner"], np.arange(sets + 1))
        asked = told[:, 0] >= ANY
        for i in np.flatnonzero(involved | near).tolist():
            at = slice(ends[i], ends[i + 1])
            keys, mine = x["keys"][at], x["mine"][at]
            for k in ("set_id", "id", "h", "n", "t", "root", "need"):
                out[k].append(int(x[k][i]))
            for k, v in (("light", x["light"]), ("heavy", x["heavy"]), ("near", near), ("involved", involved)):
                out[k].append(bool(v[i]))
            out["block"].append(int(keys[np.argmax(x["df"][at])].view(np.int64)))
            out["own"].append((keys[asked[at]] if final else keys[mine]).tobytes())
            out["other"].append(b"" if final else keys[~mine].tobytes())
            out["short"].append(keys[x["role"][at] & SHORT > 0].view(np.int64).tolist() if final and x["light"][i] else [])
        return _rows(out, FOUND)

    return lambda batches: _with_replies(batches, close)


def _search(sets: DataFrame, entries: int, name: str, long: int | None, classed: bool, final: bool) -> DataFrame:
    """Queries among `sets` (SET, own, other) that may have partners, and those that may be partners."""
    buckets, parts = max(8, -(-entries // RANGE)), common.parts_for(sets.sparkSession, entries, BLOCK)
    by_set = sets.select(*SET, "own", "other").repartition(parts, "set_id").sortWithinPartitions("set_id", "id", "h")
    blocks = common.materialise(by_set.mapInArrow(common.tidy(_to_blocks), BLOCKS), f"{name}-blocks")
    edges = _edges(sets, buckets)

    def turn(blocks: DataFrame, send, answer, close, schema: str, what: str) -> DataFrame:
        pairs = blocks.mapInArrow(common.tidy(send(edges)), PAIRS).repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
        replies = common.materialise(pairs.mapInArrow(common.tidy(answer), BLOCKS), f"{name}-replies")
        back = blocks.union(replies).repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")
        out = common.materialise(back.mapInArrow(common.tidy(close), schema), f"{name}-{what}")
        common.drop(blocks)
        common.drop(replies)
        return out

    plans = turn(blocks, _send_counts if classed else _send_single, _counts, _plan(long), BLOCKS, "plans")
    return turn(plans, _send_wishes, _wishes, _reached(final), FOUND, "found")


def _cells(batches):
    """Rows sorted by (block, cell): which shingles a cell's members have, their classes and sizes."""
    at, held = None, []

    def close():
        keys = np.concatenate([np.frombuffer(k, dtype=np.uint64) for _, _, k in held])
        sizes = [len(k) // 8 for _, _, k in held]
        root, n = (np.repeat(np.array([r[i] for r in held], dtype=np.int64), sizes) for i in (0, 1))
        order, starts, distinct = _grouped(keys)
        if not len(distinct):
            return None
        spread = [f.reduceat(v[order], starts) for f, v in ((np.minimum, root), (np.maximum, root), (np.minimum, n), (np.maximum, n))]
        columns = dict(zip(("lo", "hi", "small", "large"), spread)) | {"key": distinct.view(np.int64)}
        columns |= {k: np.full(len(distinct), v, dtype=np.int64) for k, v in zip(("block", "cell"), at)}
        return _rows(columns, CELLS)

    for b in batches:
        for block, cell, *r in zip(*(b.column(k).to_pylist() for k in ("block", "cell", "root", "n", "own"))):
            if (block, cell) != at:
                if held and (out := close()):
                    yield out
                at, held = (block, cell), []
            held.append(r)
    if held and (out := close()):
        yield out


CELLS = "key long, block long, cell long, lo long, hi long, small long, large long"


# --- the search inside cells ------------------------------------------------------------------------------------------


class Lists:
    """Inverted lists over some sets, which are numbered from the smallest (`order`: their places in `sets`)."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], dtype=np.int64)
        self.order = np.argsort(size, kind="stable")
        self.sets, self.size = [sets[i] for i in self.order], size[self.order]
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(sets)), self.size)
        by_hash = np.lexsort((owner, flat))
        self.flat, self.owner = flat[by_hash], owner[by_hash]

    def search(self, s: np.ndarray, others: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Those of `others` (a mask of sets no smaller than `s`) that the short lists leave, with the counts so far, and
        the shingles whose long lists were skipped."""
        low, high = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        length = high - low
        t = required(len(s), len(s))
        by_length = np.argsort(-length, kind="stable")
        n_long = min(t - 1, int((length > LONG).sum()))
        short = by_length[n_long:]
        total = length[short]
        at = np.repeat(low[short] - (np.cumsum(total) - total), total) + np.arange(total.sum())
        count = np.bincount(self.owner[at], minlength=len(self.sets))
        return np.flatnonzero((count >= max(1, t - n_long)) & others).tolist(), count, s[by_length[:n_long]]

    def linked(self, s: np.ndarray, b: int, counted: int, probes: np.ndarray) -> bool:
        """Whether set b links with `s`: its short lists' count and the long lists, probed in b itself."""
        other = self.sets[b]
        if len(probes):
            hit = np.searchsorted(other, probes)
            counted += int((other[np.minimum(hit, len(other) - 1)] == probes).sum())
        return counted >= required(len(s), len(other))


def links_of(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among some sets by T-occurrence search, enough of them to join every class (a pair already joined by
    others is passed over). Sets are queried from the smallest; each asks for partners no smaller than itself."""
    lists = Lists(sets)
    root = np.arange(len(sets))
    found = []
    for a in range(len(sets) - 1):
        others = root != root[a]
        others[: a + 1] = False
        if not others.any():
            continue
        s = lists.sets[a]
        candidates, count, probes = lists.search(s, others)
        for b in candidates:
            if root[b] != root[a] and lists.linked(s, b, int(count[b]), probes):
                found.append((int(lists.order[a]), int(lists.order[b])))
                root[root == root[b]] = root[a]
    return found


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The classes that some links make, as links of each member to the least one: chains would cost `components` rounds."""
    over = {}

    def top(x: int) -> int:
        while over.setdefault(x, x) != x:
            over[x] = x = over[over[x]]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        over[high] = low
    return [(x, top(x)) for x in list(over) if top(x) != x]


def _block_links(batches):
    """Rows sorted by (block, salt) to links of set_ids; a sub-block has SUB_BLOCK rows or so and its leader."""
    import pyarrow as pa

    held, at = {}, None

    def close():
        ids = list(held)
        if len(ids) < 2:
            return None
        pairs = stars([(ids[a], ids[b]) for a, b in links_of([np.frombuffer(held[i], dtype=np.uint64) for i in ids])])
        if not pairs:
            return None
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("block", "salt", "set_id")]
        data = batch.column("shingles")
        for i, (block, salt, set_id) in enumerate(zip(*columns)):
            if (block, salt) != at:
                out = close()
                if out:
                    yield out
                held, at = {}, (block, salt)
            held[set_id] = data[i].as_py()
    out = close()
    if out:
        yield out


def _visit_links(batches):
    """Rows sorted by (block, cell, kind), a cell's members (kind 0) before the queries that visit it (kind 1), to links
    between classes: one for each class that a query links with. A task holds one cell and a batch of queries."""
    import pyarrow as pa

    at, held, lists = None, [], None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("block", "cell", "kind", "set_id", "root")]
        data = batch.column("shingles")
        found = []
        for i, (block, cell, kind, set_id, root) in enumerate(zip(*columns)):
            if (block, cell) != at:
                at, held, lists = (block, cell), [], None
            s = np.frombuffer(data[i].as_py(), dtype=np.uint64)
            if kind == 0:
                held.append((set_id, root, s))
                continue
            if lists is None:
                if not held:
                    continue
                lists = Lists([x for _, _, x in held])
                ids, roots = (np.array([held[j][k] for j in lists.order], dtype=np.int64) for k in (0, 1))
            others = (roots != root) & ((lists.size > len(s)) | ((lists.size == len(s)) & (ids > set_id)))
            if not others.any():
                continue
            candidates, count, probes = lists.search(s, others)
            joined = set()
            for b in candidates:
                if roots[b] not in joined and lists.linked(s, b, int(count[b]), probes):
                    joined.add(roots[b])
                    found.append((set_id, int(ids[b])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): least node of its class. Least labels spread along links and along
    the labels themselves (a label's own label), so the rounds grow with the logarithm of a class's diameter."""
    edges = common.materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.materialise(edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as root"), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(seen, "node").selectExpr("node", "root as old", "least(root, m) as root")
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        jumped = hooked.join(up, "root", "left").selectExpr("node", "old", "least(root, over) as root")
        after = common.materialise(jumped, "labels")
        changed = after.where("root <> old").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


def _classes(docs: DataFrame) -> DataFrame:
    """id, h, n, set_id, component, root for every row of `docs` (id, h, text); a class has one root."""
    spark = docs.sparkSession
    common.ship(spark)
    sketch = common.materialise(docs.mapInArrow(common.tidy(_sketch), "id long, h long, set_id long, n long, t long, own binary, other binary"), "sketch")
    slim = common.materialise(sketch.select("id", "h", "set_id", "n"), "slim")
    size = "cast(sum(octet_length(own) + octet_length(other)) div 8 as long) as entries"
    alone = sketch.where("own is not null").selectExpr("*", "set_id as root", "1L as asks", "1L as least")
    found = _search(alone, sketch.selectExpr(size).first()[0] or 0, "all", LONG, False, False)
    common.drop(sketch)

    sizes = found.groupBy("block").agg(F.count("*").alias("c"), F.min("set_id").alias("leader"), F.max("set_id").alias("leader2"))
    sizes = sizes.selectExpr("block", "leader", "leader2", f"if(c > 1, cast(ceil(c / {SUB_BLOCK}) as long), 0L) as salts")
    placed = found.select("set_id", "id", "h", "block").join(sizes, "block")
    texts = docs.join(placed, ["id", "h"]).select("set_id", "block", "leader", "leader2", "salts", "text")
    sets = texts.mapInArrow(common.tidy(_add_shingles), "set_id long, block long, leader long, leader2 long, salts long, shingles binary")
    sets = common.materialise(sets.dropDuplicates(["set_id"]), "sets")
    total, most = found.agg(F.sum("n"), F.count("*")).first()
    total, mean = total or 0, (total or 0) // max(1, most)

    members = sets.where("salts > 0")
    turns = members.selectExpr("*", f"explode(if(salts > 1, sequence(0L, {TURNS - 1}L), array(0L))) as turn")
    dealt = turns.selectExpr("block", "turn * salts + pmod(xxhash64(set_id, turn), salts) as salt", "set_id", "shingles")
    heads = turns.where("salts > 1 and set_id = if(turn = 1, leader2, leader)")
    leaders = heads.selectExpr("block", "explode(sequence(turn * salts, turn * salts + salts - 1)) as salt", "set_id", "shingles")
    blocks = dealt.union(leaders).repartition(common.parts_for(spark, TURNS * total, BLOCK), "block", "salt").sortWithinPartitions("block", "salt")
    first = common.materialise(blocks.mapInArrow(common.tidy(_block_links), "a long, b long"), "links")
    known = components(first)

    roots = known.withColumnRenamed("node", "set_id")
    classed = found.select("set_id", "id", "h", "n", "t", "own", "other").join(roots, "set_id", "left")
    classed = classed.selectExpr("*", "coalesce(root, set_id) as c", "1L as asks", "1L as least").drop("root").withColumnRenamed("c", "root")
    again = _search(classed, found.selectExpr(size).first()[0] or 0, "mixed", LONG, True, True)
    common.drop(found)
    # what is heavy or near even so: by all shingles; a set with fewer shared ones than its least overlap is neither query nor partner
    near = again.where("near").selectExpr("set_id", "id", "h", "n", "root", "cast(heavy as long) as asks")
    whole = near.join(sets.select("set_id", "shingles"), "set_id").selectExpr(
        "set_id", "id", "h", "n", "(8 * n + 8) div 9 as t", "root", "asks", "(4 * n + 4) div 5 as least", "shingles as own", "cast('' as binary) as other"
    )
    entries = near.selectExpr("sum(n) as entries").first()[0] or 0
    every = again.where("involved")
    if entries:
        every = every.union(_search(whole, entries, "whole", None, True, True))

    # a query visits the cells where `need` of its lists have members that it might link with, of other classes
    place = sets.selectExpr("set_id", "block", "pmod(xxhash64(set_id), greatest(salts, 1L)) as cell")
    hosts = every.select("set_id", "n", "root", "own").join(place, "set_id").repartition("block", "cell").sortWithinPartitions("block", "cell")
    cells = hosts.mapInArrow(common.tidy(_cells), CELLS)
    asked = every.selectExpr("set_id", "n", "root", "need", "explode(short) as key")
    visits = asked.join(cells, "key").where("(lo <> root or hi <> root) and large >= n and 4 * small <= 5 * n")
    visits = visits.groupBy("set_id", "root", "need", "block", "cell").agg(F.count("*").alias("c")).where("c >= need")
    visits = common.materialise(visits.select("set_id", "root", "block", "cell"), "visits")
    visited = visits.selectExpr("block as b", "cell as c").distinct()
    members = place.join(visited, F.expr("block = b and cell = c"), "left_semi").join(roots, "set_id", "left")
    members = members.selectExpr("set_id", "coalesce(root, set_id) as root", "block", "cell", "0 as kind").union(visits.selectExpr("set_id", "root", "block", "cell", "1 as kind"))
    rows = members.join(sets.select("set_id", "shingles"), "set_id").select("block", "cell", "kind", "set_id", "root", "shingles")
    rows = rows.repartition(common.parts_for(spark, 2 * visits.count() * mean, BLOCK), "block", "cell").sortWithinPartitions("block", "cell", "kind")
    second = common.materialise(rows.mapInArrow(common.tidy(_visit_links), "a long, b long"), "links")
    final = components(known.where("node <> root").selectExpr("node as a", "root as b").union(second)) if second.limit(1).count() else known  # the classes so far are stars

    own = slim.where("n > 0").groupBy("set_id").agg(F.min("id").alias("mine")).join(final.withColumnRenamed("node", "set_id"), "set_id", "left")
    own = own.selectExpr("set_id", "mine", "coalesce(root, set_id) as root")
    linked = own.join(final.selectExpr("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("mine").alias("least"))
    own = own.join(linked, "root", "left").selectExpr("set_id", "root", "coalesce(least, mine) as least")
    out = slim.join(own, "set_id", "left").selectExpr("id", "h", "n", "set_id", "if(n > 0, least, id) as component", "root")
    return common.materialise(out, "classes")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    return docs.select(key.alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("text"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, set_id (equal sets, equal ids), root (one for each class)."""
    null = f"{NULL_ID + 1}L - 1L"
    out = _classes(_keyed(docs, text, doc_id))
    return out.selectExpr(f"nullif(id, {null}) as doc_id", "n as n_shingles", f"nullif(component, {null}) as component_id", "set_id", "root")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one row of each class: the one with the smallest doc_id, and of several such the one whose text's hash is
    least. Rows with an empty set all stay. Of rows that share doc_id and text, in a class, the one stays whose other columns'
    hash is least."""
    found = _classes(_keyed(docs, text, doc_id)).where("n > 0")
    best = found.groupBy("root").agg(F.min(F.struct("id", "h")).alias("best"))
    judged = found.groupBy("root", "id", "h").agg(F.count("*").alias("copies")).join(best, "root")
    judged = common.materialise(judged.selectExpr("id", "h", "struct(id, h) <> best as gone", "copies"), "judged")
    i, h, row = common.free_names(docs, "id", "h", "row")
    names = [common.quoted(c) for c in docs.columns]
    judged = judged.withColumnsRenamed({"id": i, "h": h})
    mine, words = F.col(common.quoted(doc_id)), F.col(common.quoted(text))
    same = F.coalesce(mine.cast("long"), F.lit(NULL_ID)).eqNullSafe(F.col(i)) & F.xxhash64(words.cast("string")).eqNullSafe(F.col(h))
    kept = docs.join(judged.where("gone").select(i, h), same, "left_anti")
    again = judged.where("not gone and copies > 1").select(i, h)
    if not again.limit(1).count():
        return kept
    several = kept.join(again, same, "left_semi")
    order = Window.partitionBy(mine, words).orderBy(F.xxhash64(*names))
    one = several.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*names)
    return kept.join(again, same, "left_anti").union(one)
