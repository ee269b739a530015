"""Maps larger than a task: entries of one file come out of several tasks and equal the map's."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ragloom.sources import readers

TRICKY = ['}', '{', '"', '\\', '\\"', '}"', '{"a": 1}', '],[', 'plain', '', 'é☃\n\t', '\\\\}', '",{"x":{']


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice(TRICKY) + rng.choice(TRICKY)
    if kind == 1:
        return rng.choice([None, True, -2, 1.5])
    if kind == 2:
        return [rng.choice(TRICKY) for _ in range(rng.randrange(3))]
    if kind == 3:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TRICKY) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(5))}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_map(spark, small_splits, tmp_path, indent, seed):
    rng = random.Random(seed)
    made = {f"{rng.choice(TRICKY)}{i}": nested(rng) for i in range(150)} | {"long": "}{" * 2000, "after": {"z": []}}
    for i, ends in enumerate(["", "\n", " \n "]):
        (tmp_path / f"m{i}.json").write_text(json.dumps(made, indent=indent, ensure_ascii=seed == 1) + ends)
    rows = readers.json_map(spark, str(tmp_path)).select("file", "key", F.to_json("value").alias("value"))
    found = {}
    for r in rows.collect():
        assert found.setdefault(r.file, {}).setdefault(r.key, r.value) is r.value, "a key twice"
    assert len(found) == 3
    for got in found.values():
        assert {k: json.loads(v) for k, v in got.items()} == made


def test_several_tasks(spark, small_splits, tmp_path):
    made = {f"q{i}": {"question": "x" * (i % 50), "annotations": [{"answers": ["}"], "count": i}]} for i in range(300)}
    (tmp_path / "m.json").write_text(json.dumps(made))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few, so they'd be put together again
    try:
        rows = readers.annotations(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.qid: r.annotation["annotations"][0]["count"] for r in rows} == {f"q{i}": i for i in range(300)}
    assert len({r.task for r in rows}) > 1


def test_edges(spark, tmp_path):
    for name, text in {"empty": "", "blank": " \n", "none": "{}", "spaced": " { } \n", "flat": '{"a": 1, "b": 2}', "bom": '﻿{"c": {}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = readers.json_map(spark, str(tmp_path), "string").collect()
    assert sorted((r.key, r.value) for r in rows) == [("a", "1"), ("b", "2"), ("c", "{}")]


def test_the_last_of_equal_keys(spark, small_splits, tmp_path):
    (tmp_path / "m.json").write_text("{" + ",".join(f'"k{i % 3}": {{"v": {i}, "pad": "{"x" * 90}"}}' for i in range(60)) + "}")
    last = readers.last_match(readers.json_map(spark, str(tmp_path), "struct<v:int>"), ["key"], "position").collect()
    assert {r.key: r.value.v for r in last} == {"k0": 57, "k1": 58, "k2": 59}


def test_broken_files_fail(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"v": 1}, "b": {"v": }, "c": {"v": 3}}')
    with pytest.raises(Exception):
        readers.json_map(spark, str(tmp_path), "struct<v:int>").collect()
