import hashlib
import random
import re

import numpy as np
import pytest
from helpers import ROWS, clashing, documents, rows

from ragloom.llm import common, fm_index, jaccard_join

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data):
    sets = [(i if i is not None else -(2**63), shingles(t)) for i, t in data]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    null = lambda i: None if i == -(2**63) else i
    return sorted(((null(i), len(s), null(least[find(a)] if s else i)) for a, (i, s) in enumerate(sets)), key=str)


def corpus(seed, groups=6, size=30):
    """Groups of near copies, chains that link at the edge of the threshold, a passage many share, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(50)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 30))):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    for _ in range(40):
        out.append(" ".join(passage + [word() for _ in range(rng.randrange(0, 60))]))
    for _ in range(20):
        out.append(" ".join(passage[: rng.randrange(1, 9)]))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def test_classes_on_edge_cases(spark):
    got = jaccard_join.classes(clashing(documents(spark)))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute([(r[0], r[1]) for r in ROWS])
    assert jaccard_join.classes(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed, long, sub, block", [(1, 100, 64, 1_000_000), (2, 3, 8, 300), (3, 1, 3, 60)])
def test_classes_against_brute_force(spark, monkeypatch, seed, long, sub, block):
    """Small bounds send small data through long lists, heavy queries, dealt blocks, and many blocks and ranges."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "RANGE", block * 4)
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "SUB_BLOCK", sub)
    data = corpus(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert rows(jaccard_join.classes(df), "doc_id", "n_shingles", "component_id") == brute(data)


def test_block_search_finds_every_class():
    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], dtype=np.uint64)) for _, t in corpus(5, 4, 12)]
    links = jaccard_join.links_of(sets)
    for a, b in links:
        i = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i)


def test_classes_of_a_block_leave_it_as_stars(spark, monkeypatch):
    """A chain of links inside a block cost a round of labels, of five stages, for each doubling of its length."""
    base = np.sort(np.random.default_rng(5).integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.sort(base[i * 10 : i * 10 + 200]) for i in range(20)]  # each reaches the next one only
    ids = np.random.default_rng(6).permutation(20).tolist()
    data = [(7, 0, i, s.tobytes()) for i, s in zip(ids, sets)]
    df = spark.createDataFrame(data, "block long, salt long, set_id long, shingles binary").coalesce(1).sortWithinPartitions("block", "salt")
    links = common.materialise(df.mapInArrow(jaccard_join._block_links, "a long, b long"), "links")
    assert sorted((r.a, r.b) for r in links.collect()) == [(i, 0) for i in range(1, 20)]
    rounds, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    known = jaccard_join.components(links.union(spark.createDataFrame([(30, 31), (19, 31)], "a long, b long")))
    assert sorted((r.node, r.root) for r in known.collect()) == [(i, 0) for i in [*range(20), 30, 31]]
    assert rounds.count("labels") <= 4


def test_keep_one(spark):
    kept = jaccard_join.keep_one(clashing(documents(spark)))
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 11, 12, 14, 15]
    assert kept.columns == clashing(documents(spark)).columns


def test_keep_one_keeps_one_of_each_class_where_doc_ids_repeat(spark):
    a = "one two three four five six seven eight nine ten eleven"
    b = a.replace("one", "uno").replace("five", "cinco").replace("ten", "diez")
    c = "quite another text that has nothing to do with the others at all"
    data = [(5, a), (9, a), (2, b), (5, b), (7, c), (7, c), (None, c), (None, None), (None, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(kept, "doc_id", "text") == sorted([(5, a), (2, b), (None, c), (None, None), (None, "")], key=str)


ITEMS = [
    (0, "one two three four five six seven eight nine ten eleven twelve"), (1, "short item"), (2, None), (3, "..."), (4, "short item"),
    (5, "Größe ñandú a b c d e f g h i"), (10, "three four five six seven eight nine ten eleven twelve thirteen"),
]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text):
    w = bench_words(text)
    hit, items = set(), set()
    for item, t in ITEMS:
        b = bench_words(t)
        for i in range(max(1, len(b) - 9) if b else 0):
            g = b[i : i + 10]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


TEXTS = [
    "One, two THREE four five six seven eight nine ten eleven twelve thirteen!", "x " * 50 + "a short-item here", "one two three four five", None, "", "---",
    "GRÖßE größe ñandú a b c d e f g h i j", "one two three four five six seven eight nine ten " * 30, "short item short item",
]


def test_windows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 300)
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = sorted(((i, *brute_hits(t)) for i, t in [*enumerate(TEXTS), (3, None)]), key=str)
    assert rows(fm_index.digest(fm_index.scan(clashing(df), items)), "doc_id", *columns) == expected
    monkeypatch.setattr(fm_index, "PASS_BYTES", 40)  # several passes
    assert rows(fm_index.digest(fm_index.scan(df, items)), "doc_id", *columns) == expected
    assert fm_index.scan(df.where("false"), items).count() == 0
    assert not fm_index.digest(fm_index.scan(df, items.where("false"))).where("contaminated").count()


def test_remove_leaves_nothing_to_find_and_clean_rows_alone(spark):
    df = clashing(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = fm_index.remove(df, items)
    assert out.columns == df.columns
    assert not fm_index.digest(fm_index.scan(out, items)).where("contaminated").count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == TEXTS[2] and texts[3] is None and texts[4] == "" and texts[5] == "---" and 8 not in texts


def test_passes_agree_with_one_pass(spark, monkeypatch):
    texts = [*enumerate(TEXTS), (3, None), (50, " ".join(f"w{i % 4000}" for i in range(200_000)) + " short item")]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    once = rows(fm_index.remove(df, items), "doc_id", "text")
    monkeypatch.setattr(fm_index, "PASS_BYTES", 60)
    again = fm_index.remove(df, items)
    assert again.columns == df.columns and not fm_index.digest(fm_index.scan(again, items)).where("contaminated").count()
    assert [r[0] for r in rows(again, "doc_id", "text")] == [r[0] for r in once]
    assert rows(fm_index.remove(df.where("doc_id in (0, 50)"), items), "doc_id", "text") == [r for r in once if r[0] in (0, 50)]


def test_fm_index_against_plain_search():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 500)
    index = fm_index.FMIndex(text, 5, sample=4)
    patterns = np.array([[1, 2, 3], [4, 4, 0], [1, 0, 0], [2, 2, 2]])
    lengths = np.array([3, 2, 1, 3])
    low, high = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high):
        expected = [i for i in range(500 - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_ranges_hold_equally_many_entries(spark):
    """Own lists are the smallest hashes of their sets: equal widths would put nearly all of them in a fifth of the ranges."""
    rng = np.random.default_rng(4)
    rows_ = []
    for _ in range(400):
        x = np.unique(rng.integers(0, 2**64, size=300, dtype=np.uint64))
        under = int(np.searchsorted(x, np.uint64(int(0.22 * 2**64))))
        rows_.append((bytearray(x[:61].tobytes()), bytearray(x[61:under].tobytes())))
    edges = jaccard_join._edges(spark.createDataFrame(rows_, "own binary, other binary"), 16)
    flat = np.concatenate([np.frombuffer(bytes(b), dtype=np.uint64) for r in rows_ for b in r])
    held = np.diff(np.concatenate([[0], np.searchsorted(np.sort(flat), edges), [len(flat)]]))
    assert len(edges) == 15 and held.max() < 1.2 * held.mean()
    assert (np.diff(jaccard_join._edges(spark.createDataFrame([], "own binary, other binary"), 4).astype(float)) > 0).all()
