"""Appends that happen once, and model calls that overlap."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from ragloom.functions import models
from ragloom.sources.ledger import Ledger
from ragloom.streaming.resume import answer_stream

answer = lambda d: d.withColumn("response", F.upper("job_id"))


def jobs(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "job_id string")


def answered(ledger):
    return sorted(r.job_id for r in ledger.read().collect())


def test_writer_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "out"))
    assert ledger.read() is None
    assert ledger.append(jobs(spark, ["a", "b", "b", None]), ["job_id"], answer) == 2

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", dies)
        with pytest.raises(RuntimeError, match="killed"):
            ledger.append(jobs(spark, "bc"), ["job_id"], answer)
    assert answered(ledger) == ["a", "b"] and len(os.listdir(tmp_path / "out" / "rows")) == 2  # its rows are there and nobody reads them
    assert ledger.append(jobs(spark, "bcd"), ["job_id"], answer) == 2
    assert answered(ledger) == ["a", "b", "c", "d"]
    assert ledger.append(jobs(spark, "abcd"), ["job_id"], answer) == 0 and len(ledger.commits()) == 2


def test_two_writers_on_the_same_jobs(spark, tmp_path):
    one, two = Ledger(spark, str(tmp_path / "out")), Ledger(spark, str(tmp_path / "out"))
    calls = []

    def slow(d):
        calls.append(two.append(jobs(spark, "bc"), ["job_id"], answer, "two"))  # commits while the first one still works
        return answer(d)

    assert one.append(jobs(spark, "abx"), ["job_id"], slow, "one") == 2
    assert calls == [2] and answered(one) == ["a", "b", "c", "x"]
    assert [c["batch"] for c in one.commits()] == ["two", "one"]
    assert not one.commit(0, {"folder": "other", "batch": None}) and answered(one) == ["a", "b", "c", "x"]


def test_batch_that_comes_again_after_its_commit(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    run = lambda: answer_stream(spark, str(tmp_path / "jobs"), "job_id string", str(tmp_path / "out"), str(tmp_path / "cp"), work).awaitTermination()
    seen = []
    work = lambda d: (seen.append(1), answer(d))[1]
    (tmp_path / "jobs" / "1.json").write_text("".join(json.dumps({"job_id": i}) + "\n" for i in "ab"))
    run()
    for f in (tmp_path / "cp" / "commits").iterdir():
        if f.name != "metadata":
            f.unlink()  # the driver died between the batch's commit and its checkpoint
    run()
    assert answered(Ledger(spark, str(tmp_path / "out"))) == ["a", "b"] and len(seen) == 1
    (tmp_path / "jobs" / "2.json").write_text("".join(json.dumps({"job_id": i}) + "\n" for i in "bc"))
    run()
    assert answered(Ledger(spark, str(tmp_path / "out"))) == ["a", "b", "c"]


def test_requests_overlap_in_order_and_failures_stay_in_their_row(spark):
    def factory():
        state, lock = {"now": 0, "most": 0}, threading.Lock()

        def model(given):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.05 if given[0] % 2 else 0.02)
            with lock:
                state["now"] -= 1
            if given[0] == 7:
                raise KeyError("bad prompt")
            return [given[0] * 10 + 0 * state["most"] if given[0] < 39 else state["most"]]

        return model

    df = spark.range(40, numPartitions=1)
    start = time.perf_counter()
    out = models.call_each(df, "id", "said", factory, "long", window=4, retries=2, wait=0.0).collect()
    assert [r.id for r in out] == list(range(40))
    assert [r.said for r in out[:39]] == [None if i == 7 else 10 * i for i in range(39)]
    assert [r.id for r in out if r.said_error] == [7] and "bad prompt" in out[7].said_error
    assert 2 <= out[39].said <= 4  # requests under way together at most
    slow = models.call_each(spark.range(6, numPartitions=1), "id", "said", lambda: lambda g: g, "long", window=4, per_second=10.0)
    start = time.perf_counter()
    assert [r.said for r in slow.collect()] == list(range(6)) and time.perf_counter() - start >= 0.5
