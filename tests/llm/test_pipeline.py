import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def test_stages_take_effect(spark):
    from ragloom.llm import common, fm_index, jaccard_join

    docs = common.read(spark, DIR, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen.append(common.materialise(stage(spark, seen[-1], DIR), "stage"))
        assert seen[-1].columns == columns and seen[-1].dtypes == docs.dtypes, name
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    classes = jaccard_join.classes(seen[2]).where("n_shingles > 0")
    assert classes.select("component_id").distinct().count() == classes.count()
    assert not fm_index.digest(fm_index.scan(seen[3], common.read(spark, DIR, "benchmark"))).where("contaminated").count()
    assert not seen[3].where("n_chars <> length(text)").count()
    store = corpus_pipeline.STAGES[4][1](spark, seen[4], DIR)
    assert store.count() == counts[4] and store.agg({"start": "min"}).first()[0] == 0


def test_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage; empty tables give empty results."""
    from helpers import BASE, ROWS, clashing, documents

    many = [*ROWS, *((100 + i, f"calm line {i} of tea and rain that goes on for {i} days", "en", "src0") for i in range(40))]
    passage = " ".join(f"secret{i}" for i in range(12))
    many += [(200, f"before {passage} after", "en", "src1"), (201, passage, "en", "src1")]
    labels = spark.createDataFrame([(i, 1, int(i == 14)) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string")
    folder = str(tmp_path)
    for name, table in (("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{folder}/{name}.parquet")
    docs = clashing(documents(spark, many))
    texts = {"start": [r.text for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{len(texts)}")
        docs = spark.read.parquet(f"{folder}/{len(texts)}")
        texts[name] = [r.text for r in docs.collect()]
    assert {None, "", " \n\t "} <= set(texts["toxicity"]) and sum(t == BASE for t in texts["toxicity"]) == 2
    unique = texts["n-gram Jaccard join"]
    assert sum(t == BASE for t in unique) == 1 and None in unique and "" in unique and sum((t or "").startswith("word0") for t in unique) == 1
    clean = texts["benchmark decontamination"]
    assert not any("secret3" in (t or "") for t in clean) and passage not in clean and sum("before" in (t or "") and "after" in t for t in clean) == 1
    mixed = texts["mixing sources to target weights"]
    assert 0 < len(mixed) <= len(clean)
    store = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert store.count() == len(mixed)
    empty = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


@pytest.mark.parametrize("several_passes", [False, True])
def test_any_column_names(spark, tmp_path, monkeypatch, several_passes):
    """Helper columns never clash with the documents' own, dots and blanks in names included."""
    from helpers import BASE, documents
    from pyspark.sql import functions as F

    from ragloom.llm import fm_index

    if several_passes:
        monkeypatch.setattr(fm_index, "PASS_BYTES", 40)
    passages = [" ".join(f"{w}{i}" for i in range(12)) for w in ("alpha", "beta")]
    many = [(1, BASE, "en", "s"), (1, BASE, "en", "s"), (2, BASE + " more", "en", "s"), (3, f"before {passages[0]} after", "en", "s"), (4, f"{passages[1]} tail", "de", "t"), (5, "calm line", "en", "t")]
    names = ["__copies", "__doc", "__lang", "__spans", "__id", "__h", "__row", "ragloom_id", "RAGLOOM_SPANS", "ragloom_copies", "a.b", "a b", "component", "domain"]
    docs = documents(spark, many)
    for c in names:
        docs = docs.withColumn(c, F.lit("x"))
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = docs.collect()
    assert 0 < len(left) <= 4 and not any("alpha3" in r.text or "beta3" in r.text for r in left) and all(r["a.b"] == "x" for r in left)
