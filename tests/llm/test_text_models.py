import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ROWS, clashing, documents, rows
from pyspark.sql import functions as F

from ragloom.llm import html_wrapper, licenses, lm_score, mixture, multiset_hash, toxicity

# Toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("bdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    bad = ["stupid", "idiot", "pathetic"]
    out = []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(rng.randrange(1, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((i, " ".join(w), toxic))
    return out, calm


def test_held_out_accuracy_and_unseen_misspellings(spark):
    data, calm = toxic_corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    model = toxicity.train(clashing(docs), labels)
    truth = {i: y for i, _, y in data}
    held = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    of = toxicity.scorer(model)
    assert (of([f"{calm[0]} {calm[1]} {w} {calm[2]}" for w in ("stupidd", "idiott", "patheticc")]) > 0.5).all()


def test_toxicity_edges(spark):
    model = toxicity.fit(zip(["you idiot", "good day", "an idiot", "nice tea"] * 10, [1, 0, 1, 0] * 10))
    out = toxicity.score(clashing(documents(spark)), model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(documents(spark, []), model).count() == 0
    empty = toxicity.train(documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score == 0 for r in toxicity.score(documents(spark), empty).collect())
    kept = toxicity.keep_clean(clashing(documents(spark)), model)
    assert kept.columns == clashing(documents(spark)).columns and kept.where("doc_id = 4").count() == 1


def test_held_out_labels_change_nothing(spark):
    data, _ = toxic_corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    turned = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in data]
    models = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in ([(i, 1, y) for i, _, y in data], turned)]
    assert turned != [(i, 1, y) for i, _, y in data]
    assert (models[0].embedding == models[1].embedding).all() and (models[0].softmax == models[1].softmax).all()
    assert (models[0].scale, models[0].shift) == (models[1].scale, models[1].shift)


def test_scores_against_plain_sums():
    data, _ = toxic_corpus(120, 5)
    model = toxicity.fit((t, y) for _, t, y in data)
    texts = [t for _, t, _ in data] + ["", "one", "  \n", "same same same", "x" * 5000]

    def word_logit(w):
        marked = f"<{w.strip(toxicity.STRIP) or w}>"
        rows = [int(g) for g in toxicity.bags([w])[0]]
        assert len(rows) == sum(max(0, len(marked) - n + 1) for n in toxicity.GRAMS)
        mean = np.mean([model.embedding[r].astype(float) for r in rows], axis=0)
        return float(mean @ (model.softmax[:, 1].astype(float) - model.softmax[:, 0])) + float(model.bias[1] - model.bias[0])

    def plain(text):
        pooled = math.log(math.exp(toxicity.EMPTY_LOGIT) + sum(math.exp(word_logit(w)) for w in sorted(set(text.lower().split()))))
        return 1 / (1 + math.exp(-(model.scale * pooled + model.shift)))

    got = toxicity.scorer(model)(texts)
    assert len(got) == len(texts) and np.allclose(got, [plain(t) for t in texts], atol=1e-4)


# Wrapper induction
PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><div class='top'>Great Site {n0}</div><div class='note'>Every page says this.</div>"
    "<div class=body><p>First &amp; own words {n}<p>Second <b>own\n\n words</b> {n}<br>more {n}</div><div class='comments'><p>reader {n}</p></div>"
    "<ul><li>Terms<li>Contact</ul></body>"
)


def test_pages_without_landmarks(spark):
    pages = [(i, "http://a.example/x", PAGE.replace("{n0}", "").replace("{n}", str(i))) for i in range(12)] + [(99, "http://b.example/", PAGE.replace("{n}", "9"))]
    out = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[3] == "First & own words 3\nSecond own words 3 more 3"
    assert "Every page says this." in out[99]  # one page makes no template


def test_large_host_and_join_path(spark, monkeypatch):
    monkeypatch.setattr(html_wrapper, "GROUP", 4)
    pages = [(i, "HTTP://A.example:80/x", PAGE.replace("{n}", str(i))) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = rows(html_wrapper.main_text(clashing(df)), "page_id", "text", "n_chars")
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", 0)
    assert rows(html_wrapper.main_text(df), "page_id", "text", "n_chars") == first
    assert all(t == f"First & own words {i}\nSecond own words {i} more {i}" for i, t, _ in first)


def test_article_pages_and_edges(spark):
    article = "<nav><a href=/x>x</a></nav><div class='ad'>buy</div><article><h1>Title &lt;1&gt;</h1><p>a  b&nbsp;c<p>d<aside>side</aside><form>f</form></article><footer>(c)</footer>"
    data = [(1, "u", article), (2, None, None), (3, "u", ""), (4, "u", "<p>cut <b>off <a href='"), (5, "u", article), (5, "u", article), (6, "u", "plain & simple < text")]
    out = rows(html_wrapper.main_text(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id", "text")
    text = "Title <1>\na b c\nd"
    assert out == [(1, text), (2, ""), (3, ""), (4, "cut off"), (5, text), (5, text), (6, "plain & simple < text")]
    assert html_wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_never_rule_out_the_page():
    text = lambda page: html_wrapper.extract(page, None)
    assert text("<body class='home has-sidebar'><p>own words</p><div class=sidebar>x</div></body>") == "own words"
    assert text("<body class='social'><article class='post comments-open'><p>own words</p><div class=comments><article class=comment>reader</article></div></article></body>") == "own words"
    assert text("<nav>x</nav><div id=content class=with-banner><p>own words</p></div><footer>y</footer>") == "own words"
    assert text("<div class='banner wrap'><main class=social-page>own words</main></div><p>x</p>") == "own words"
    assert text("<article>own words</article><div class=comments><article class=comment>reader</article></div>") == "own words"
    assert text("<nav>x</nav><div class=related><p>own words</p></div>") == "own words"


def test_simple_tree_matching():
    def tree(spec):
        node = html_wrapper.Node(spec[0])
        node.kids = [tree(s) for s in spec[1:]]
        return node

    a, b = tree(("r", ("a",), ("b", ("x",)), ("c",))), tree(("r", ("b", ("x",), ("y",)), ("d",), ("c",)))
    assert html_wrapper.match(a, b)[id(a), id(b)] == (3, [(1, 0), (2, 2)])


def test_template_decides_where_pages_have_no_landmarks(spark, monkeypatch):
    """No article, no telling names, classes that change from page to page: only the host's template tells content from the rest."""
    monkeypatch.setattr(html_wrapper, "GROUP", 5)
    page = "<body><div><span>Our site</span></div><div class=x{c}><p>story {n} begins here</p><p>and {n} ends</p></div><div><p>{often}</p></div><div><p>Made by us</p></div></body>"
    data = [(i, "http://one.example/x", page.format(c=i % 2, n=i, often="on most pages" if i % 100 < 81 else f"once {i}")) for i in range(200)]
    data += [(1000 + i, "http://two.example/x", page.format(c=0, n=i, often="on some pages" if i % 100 < 78 else f"once {i}")) for i in range(200)]
    out = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i, _, html in data:
        n, alone = i % 1000, html_wrapper.extract(html, None)
        often = [] if n % 100 < 81 and i < 1000 else ["on some pages" if n % 100 < 78 and i >= 1000 else f"once {n}"]
        assert out[i] == "\n".join([f"story {n} begins here", f"and {n} ends", *often]) and alone != out[i] and "Our site" in alone


def test_menus_of_any_length_are_template(spark):
    """Equal items of one list share a slot, however many; pages without landmarks or telling names."""
    sizes = (10, 16, 17, 20, 40, 300)
    data = []
    for k in sizes:
        items = "".join(f"<li>entry {i} of {k}</li>" for i in range(k))
        data += [(1000 * k + i, f"http://h{k}.example/{i}", f"<body><ul class=k>{items}</ul><p>own line {i} of its page</p></body>") for i in range(30)]
    out = html_wrapper.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert len(out) == 30 * len(sizes) and all(r.text == f"own line {r.page_id % 1000} of its page" for r in out)


def test_deep_long_and_repeated_pages(spark):
    deep = "<div>" * 30_000 + "<p>deep {n}</p>" + "</div>" * 30_000
    many = "<ul>" + "".join(f"<li>{{n}} item {i}</li>" for i in range(20_000)) + "</ul>"
    data = [(i, "http://deep.example/", deep.format(n=i // 2)) for i in range(4)] + [(10 + i, "http://many.example/", many.replace("{n}", str(i))) for i in range(2)]
    out = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(4)] == ["deep 0", "deep 0", "deep 1", "deep 1"] and out[11].count("\n") == 19_999


# Licences


def test_licence_families(spark):
    lines = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "calm words\nReleased under the MIT License.", 3: "the mit campus is large and old", 4: None, 5: "",
        6: "This work is licensed under the GNU General Public License, version 3.", 7: "Licensed under CC BY-NC 4.0.", 8: "All rights reserved.",
        9: "a license to fish in the lake was given to the man", 10: "Licensed under CC BY 4.0.",
    }
    data = [(i, t) for i, t in lines.items()] + [(100 + i, f"ordinary line number {i} about the weather and tea\nsecond line {i}") for i in range(60)] + [(2, lines[2])]
    docs = clashing(spark.createDataFrame(data, "doc_id long, text string"))
    out = {r.doc_id: r.licence for r in licenses.scan(docs).collect()}
    assert [out[i] for i in range(1, 11)] == ["Apache", "MIT", "none", "none", "none", "GPL", "CC-BY-NC", "proprietary", out[9], "CC-BY"]
    assert out[9] in ("none", "unknown") and all(out[100 + i] == "none" for i in range(60)) and len(out) == 70
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_fit_counts_every_paragraph(spark):
    plain = [(i, f"the tea of the {'lake' if i % 3 else 'public'} is warm\nword{i} and more words\n\nReleased under the MIT License.") for i in range(5_000)]
    docs = spark.createDataFrame([*plain, (9_000, "Released under the Zeta License."), (9_001, None)], "doc_id long, text string").repartition(7)
    counted = licenses.corpus(docs).collect()
    assert sum(r.n for r in counted) == 2 * 5_000 + 1 and len(counted) < 10
    assert not hasattr(licenses, "SAMPLE")


def test_licence_texts_and_wrapped_notices(spark):
    mit = 'Copyright (c) 2020 A. Writer\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.'
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    isc = "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    lines = {1: mit, 2: bsd, 3: isc, 4: "This is free and unencumbered software released into the public domain.", 5: "Licensed under the Apache License,\nVersion 2.0", 6: "weather and tea\nAll rights\nreserved.", 7: "hereby we go to the lake"}
    data = [*lines.items()] + [(100 + i, f"ordinary line number {i} about the weather and tea\nsecond line {i}") for i in range(60)]
    out = {r.doc_id: r.licence for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(1, 8)] == ["MIT", "BSD", "ISC", "Unlicense", "Apache", "proprietary", "none"]
    assert all(out[100 + i] == "none" for i in range(60))


def test_licence_edges(spark):
    long = "the tea is warm today. " * 20_000 + "\n\nLicensed under the Apache License, Version 2.0.\n" + "and cold tomorrow " * 20_000
    rows = [(None, "Released under the MIT License."), (1, long), (2, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (2, None), (3, None)]
    docs = clashing(spark.createDataFrame(rows + [(100 + i, f"plain line {i} on rain") for i in range(40)], "doc_id long, text string"))
    out = {r.doc_id: r.licence for r in licenses.scan(docs).collect()}
    assert (out[None], out[1], out[2], out[3]) == ("MIT", "Apache", "Apache,MIT", "none") and len(out) == 44


# Mixing


def test_water_filling_and_prefixes(spark):
    rng = random.Random(4)
    data = [(i, "w " * rng.randrange(0, 9), rng.choice(["en", "de", None]), f"s{min(rng.randrange(12), 5)}") for i in range(400)] + [(None, "w w", "en", "s1"), (7, "w", "en", "s0")]
    docs = clashing(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    out = mixture.choose(docs, 1, 3, 2)
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    columns = ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]
    found = con.sql(mixture.oracle_sql(1, 3, 2))
    order = [found.columns.index(c) for c in columns]
    assert rows(out, *columns) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)
    total = sum(len((t or "").split()) for _, t, _, _ in data)
    assert sum(r.n_tokens * r.copies for r in out.collect()) <= total // 3


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "top string, low string, tokens long")
    got = {r.low: r.budget for r in mixture.allocate(leaves, 400, 2010, 1, {}, ["top", "low"]).collect()}
    assert got == {"x": 10, "y": 190, "z": 200}
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "z", 1000)], "top string, low string, tokens long")
    got = {r.low: r.budget for r in mixture.allocate(leaves, 400, 1030, 1, {}, ["top", "low"]).collect()}
    assert got == {"x": 10, "y": 20, "z": 370}


def test_select_keeps_columns(spark):
    docs = clashing(documents(spark))
    out = mixture.select(docs, numerator=1, denominator=1, max_epochs=1)
    assert out.columns == docs.columns and out.where("doc_id = 9").count() == 1 and mixture.select(documents(spark, [])).count() == 0


# Fingerprints


def test_fingerprints_are_multiset_sums(spark):
    texts = {1: "a b. c\nd e\nf", 2: "f\na b. c\nd e", 3: "a b. c\nd e", 4: "f", 5: "", 6: "a b. c\nd e\nf\nf"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fp = multiset_hash.fingerprints(df, ["doc_id"]).select("doc_id", multiset_hash.text_form(F.col("sums"), F.col("signs")).alias("x"))
    got = {r.doc_id: r.x for r in fp.collect()}
    assert got[1] == got[2] != got[6] and len(set(got.values())) == 5
    pair = spark.createDataFrame([(got[1], got[4], got[3])], "whole string, part string, rest string")
    r = pair.select(multiset_hash.remove(F.col("whole"), F.col("part")).alias("a"), multiset_hash.add(F.col("rest"), F.col("part")).alias("b")).first()
    assert (r.a, r.b) == (got[3], got[1])


def brute_lanes(text):
    """(sums, signs) with plain integers."""
    import hashlib

    sums, signs = [0] * multiset_hash.SUM_LANES, [0] * multiset_hash.SIGN_LANES
    for paragraph in text.split("\n"):
        digest = hashlib.sha256(paragraph.encode()).hexdigest()
        for i in range(len(sums)):
            sums[i] = (sums[i] + int(digest[8 * i : 8 * i + 8], 16)) % 2**32
        for clause in re.split("[.,]+ *", paragraph):
            if clause:
                digest = hashlib.md5(clause.encode()).hexdigest()
                for half in (0, 1):
                    word = int(digest[8 * half : 8 * half + 8], 16)
                    for i in range(32):
                        signs[32 * half + i] += 1 if word >> i & 1 else -1
    return sums, signs


def brute_likeness(a, b):
    if a == b:
        return 1.0
    norm = sum(x * x for x in a[1]) * sum(x * x for x in b[1])
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a[1], b[1])) / math.sqrt(norm))) if norm else 0.0


def test_lanes_and_likeness_against_plain_integers(spark):
    texts = ["x\n  b", "  b\nx", "one, two. three\nfour", "four\none, two. three", "", "...", "a.b.c.d,e\n\n f ,g", "one, two. other\nfour, five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in multiset_hash.report(df).collect()}
    assert len(out) == len(texts) and out[0].fingerprint == out[1].fingerprint and out[2].fingerprint == out[3].fingerprint
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own = brute_lanes(t)
        for got, lanes in ((out[i].fingerprint, own), (out[i].edited_fingerprint, brute_lanes(edited))):
            assert got == "".join(f"{x % 2**32:08x}" for x in [*lanes[0], *lanes[1]])
        assert out[i].near_edited == pytest.approx(brute_likeness(own, brute_lanes(edited))) and out[i].near_next == pytest.approx(brute_likeness(own, brute_lanes(following)))


@pytest.mark.parametrize("each, quantiles", [(3, 4096), (2, 7)])
def test_far_off_ids_leave_ranges_small_and_in_order(spark, monkeypatch, each, quantiles):
    from ragloom.llm import common

    monkeypatch.setattr(common, "QUANTILES", quantiles)
    ids = [-(2**63) + 1, *range(200), 10**15, 2**63 - 1, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.b for r in common.with_range(df, "doc_id", "b", len(ids), each).collect()}
    assert got.pop(None) == -1
    places = [got[i] for i in sorted(got)]
    assert places == sorted(places) and max(Counter(places).values()) <= max(3 * each, 2 * len(ids) // quantiles)


def test_fingerprint_report(spark, monkeypatch):
    import hashlib

    out = multiset_hash.report(clashing(documents(spark))).collect()
    ordered = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = []
    for i, (doc, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        h = len(t) // 2
        expected.append((doc, len(t), hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == sorted(expected, key=str)
    by_text = {}
    for r in out:
        by_text.setdefault(next(t for d, t in ordered if d == r.doc_id), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert next(r.near_next for r in out if r.doc_id == 1) == 1.0
    assert multiset_hash.report(documents(spark, [])).count() == 0


def test_likeness_of_texts_that_repeat_a_clause_often(spark):
    rows = [(1, "the same line\n" * 100_000), (2, "0," * 10_000), (3, "of its own")]
    out = {r.doc_id: r for r in multiset_hash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].near_edited > 0.9 and out[2].near_edited > 0.9 and out[1].near_next < 0.6


# Language-model scores


def brute_scores(data, order=3, alpha=0.4):
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    docs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for _, t in data]
    own = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in docs]
    corpus = [sum((o[n] for o in own), Counter()) for n in range(order)]
    size, out = sum(map(len, docs)), []
    for (doc, _), w, o in zip(data, docs, own):
        c = lambda g: corpus[len(g) - 1][g] - o[len(g) - 1][g]  # noqa: B023, E731
        score, n_backoff, n_new, others = 0.0, 0, 0, size - len(w)
        for i in range(len(w)):
            most = min(i + 1, order)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    score += math.log(c(g) / (c(g[:-1]) if n > 1 else others)) + (most - n) * math.log(alpha)
                    n_backoff += n < most
                    break
            else:
                score += most * math.log(alpha) - math.log(others + 1)
                n_new += 1
        out.append((doc, len(w), round(score, 3), n_backoff, n_new))
    return sorted(out, key=str)


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 5_000)
    got = lm_score.score(clashing(documents(spark)).repartition(3), buckets=5).collect()
    ours = sorted(((r.doc_id, r.n_words, round(r.log_score, 3), r.n_backoff, r.n_unseen) for r in got), key=str)
    expected = brute_scores([(r[0], r[1]) for r in ROWS])
    assert len(ours) == len(expected)
    for a, b in zip(ours, expected):
        assert a[:2] == b[:2] and a[3:] == b[3:] and abs(a[2] - b[2]) < 0.01
    assert all((r.mean_log is None) == (r.n_words == 0) for r in got)
    assert lm_score.score(documents(spark, [])).count() == 0
