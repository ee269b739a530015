"""Edge semantics on small tables, published aggregates, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from ragloom.functions import models, scores, text
from ragloom.operators import gate, jobs, retrieval, scoring, tuning
from ragloom.sources import readers, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_tokens_of_many_scripts(spark):
    assert one(spark, text.tokens(F.col("t")), t="Çay İ ጤፍ 12½ café a_b") == ["çay", "i", "ጤፍ", "12½", "café", "a_b"]


def test_mentions_whole_words_with_pattern_characters(spark):
    n = lambda c: text.normalize(F.col(c))
    assert one(spark, text.mentions(n("t"), n("g")), t="a C++ (new) tea.", g="c++ (new)")
    assert not one(spark, text.mentions(n("t"), n("g")), t="teapot", g="tea")


def test_fill_all_expands_once(spark):
    made = text.fill_all("{a} and {b}", {"a": F.col("a"), "b": F.col("b")})
    assert one(spark, made, a="{b}", b="x") == "{b} and x"


def test_context_block_is_empty_without_cards(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, text.context_block(F.col("p"), empty), p="Spain") == ""
    assert one(spark, text.context_block(F.col("p"), F.array(F.lit("x"))), p="Spain").endswith("[1] x\n\n")


@pytest.mark.parametrize("given, out", [("Answer: Churros.", "churros"), ("churros..", "churros"), ("", ""), (" Response : A. B.", "a. b")])
def test_clean_response(spark, given, out):
    assert one(spark, text.clean_response(F.col("t")), t=given) == out


def test_minmax_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("q", 2.0), ("q", 2.0), ("r", 1.0), ("r", 3.0)], "q string, s double")
    assert sorted(r.m for r in df.select(scores.minmax(F.col("s"), "q").alias("m")).collect()) == [0.0, 0.0, 0.0, 1.0]


def test_f_beta_guards(spark):
    z = F.lit(0)
    assert one(spark, scores.f_beta(z, z, z), a=1) == 0.0
    assert abs(one(spark, scores.f_beta(F.lit(1), F.lit(1), F.lit(0)), a=1) - 1.25 * 0.5 / (0.25 * 0.5 + 1)) < 1e-12


def test_sigmoid_only_for_logits(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 0.9), ("b", -1.0), ("b", 0.0)], "g string, s double")
    out = {(r.g, r.s): r.x for r in df.select("g", "s", scores.sigmoid_if_logits(F.col("s"), "g").alias("x")).collect()}
    assert out[("a", 0.2)] == 0.2 and out[("b", 0.0)] == 0.5


def test_bm25_without_common_term_and_with_negative_idf(spark):
    cards = spark.createDataFrame([("c", 1, "tea tea cup"), ("c", 2, "tea pot"), ("c", 3, "tea"), ("d", 4, "tea")], "country string, card_id int, text_en string")
    asked = spark.createDataFrame([("c", 0, "tea cup"), ("c", 1, "sky")], "country string, item_id int, question string")
    got = {(r.item_id, r.card_id): r.bm25 for r in retrieval.bm25(cards, asked).collect()}
    assert set(got) == {(i, c) for i in (0, 1) for c in (1, 2, 3)}  # no card of another region
    assert got[(1, 1)] == 0.0 and got[(0, 1)] > got[(0, 2)]


def test_top_k_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([("q", 3, 1.0), ("q", 1, 1.0), ("q", 2, 1.0)], "q string, card_id int, s double")
    assert sorted(r.card_id for r in retrieval.top_k(df, 2, ["q"], "s").collect()) == [1, 2]


def test_first_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.2, 2.0), (2, 0.3, 2.0)], "pos int, a double, m double")
    assert tuning.first_best(df, "a", "m").first()["a"] == 0.2


def test_gap_of_one_card(spark):
    f = gate.score_features(F.col("s"))
    assert one(spark, f["r_gap"], s=[0.7]) == 0.7


def test_auc_against_pairs(spark):
    rows = [(1.0, 0.3), (0.0, 0.3), (1.0, 0.9), (0.0, 0.1), (0.0, 0.9), (None, 0.5)]
    df = spark.createDataFrame(rows, "help double, p double")
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    expected = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(gate.auc(df, "help", "p").first()["auc"] - expected) < 1e-6
    assert gate.auc(df.where("help = 1"), "help", "p").count() == 0


def test_help_label_and_best_of_two(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (None, 1.0), (float("nan"), 0.0)], "b double, v double")
    df = readers.no_nan(df)
    assert [r.x for r in df.select(gate.help_label(F.col("b"), F.col("v")).alias("x")).collect()] == [1.0, 0.0, None, None, None]
    assert [r.x for r in df.select(gate.best_of_two(F.col("b"), F.col("v")).alias("x")).collect()] == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_strict_lookup_fails_on_a_missing_key(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        jobs.strict(a, b, ["k"]).collect()
    assert {r.v for r in jobs.lenient(a, b, ["k"], {"v": ""}).collect()} == {"x", ""}


def test_division_asks_for_every_member(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 0), ("c", "z", 1), ("c", "x", 1), ("c", None, 1), ("d", "x", 0)], "g string, m string, ok int")
    divisor = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "m string")
    out = {r.g: (r.has, r.wanted, r.every) for r in jobs.divide(rows, "g", "m", F.col("ok") == 1, divisor).collect()}
    assert out == {"a": (2, 2, True), "b": (1, 2, False), "c": (1, 2, False)}
    assert jobs.divide(rows, "g", "m", F.col("ok") == 1, divisor.where("false")).count() == 0


def test_mean_of_means_rounds_first(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "p", 0), ("a", "p", 0), ("a", "q", 1), ("a", "q", None)], "model string, p string, score int")
    assert scoring.mean_of_means(df, [["model", "p"], ["model"]], digits=2).first()["m"] == (33.33 + 100) / 2


def test_balanced_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 5), ("b", 3), ("c", 2), ("d", 2)) for i in range(n)], "template string, i int")
    folds = {r.template: r.fold for r in gate.balanced_folds(df, "template", 2).collect()}
    assert folds["a"] != folds["b"] and set(folds) == set("abcd")


def test_population_scale_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = gate.population_scale(df, ["a", "b"]).collect()
    assert [(r.a_scaled, r.b_scaled) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "gemma.jsonl").write_text('{"job_id": "a", "response": "ጤፍ"}\n\n{"job_id": "b"}\n')
    rows = readers.from_files(spark, str(tmp_path / "raw"), readers.ANSWER, "who").collect()
    assert {(r.job_id, r.response, r.who) for r in rows} == {("a", "ጤፍ", "gemma"), ("b", None, "gemma")}
    sinks.jsonl(spark.createDataFrame([("ጤ", None)], "a string, b string"), str(tmp_path / "out"))
    line = "".join(part.read_text() for part in (tmp_path / "out").glob("part-*"))  # an empty part may come first
    assert json.loads(line) == {"a": "ጤ", "b": None} and "ጤ" in line
    note = {"q1": {"question": "x", "en_question": "y", "annotations": [{"answers": ["a"], "en_answers": ["b"], "count": 4}], "idks": {"idk": 0, "no-answer": 1, "not-applicable": 0}}}
    (tmp_path / "notes.json").write_text(json.dumps(note))
    row = readers.annotations(spark, str(tmp_path / "notes.json")).first()
    assert row.qid == "q1" and row.annotation["annotations"][0]["count"] == 4 and row.annotation["idks"]["no-answer"] == 1
    (tmp_path / "q.csv").write_text('ID,Topic,Question,Translation\n1,Food,"¿Qué ""es""?",What?\n')
    assert readers.questions(spark, str(tmp_path / "q.csv"), "Spain").first()["q_local"] == '¿Qué "es"?'


def test_duplicate_template_ids(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "id string, at int, t string")
    assert readers.first_match(df, ["id"], F.col("at")).first()["t"] == "a"
    assert readers.last_match(df, ["id"], "at").first()["t"] == "b"


def test_append_missing_resumes(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "job_id string")
    work = lambda d: d.withColumn("response", F.lit("r"))
    out = str(tmp_path / "out")
    assert sinks.append_missing(df.where("job_id = 'a'"), spark, out, ["job_id"], work) == 1
    assert sinks.append_missing(df, spark, out, ["job_id"], work) == 1
    assert sinks.append_missing(df, spark, out, ["job_id"], work) == 0
    assert spark.read.parquet(out).count() == 2


def test_stream_answers_each_job_once(spark, tmp_path):
    from ragloom.sources.ledger import Ledger
    from ragloom.streaming.resume import answer_stream

    (tmp_path / "jobs").mkdir()
    for name, ids in (("1", "ab"), ("2", "bc")):
        (tmp_path / "jobs" / f"{name}.json").write_text("".join(json.dumps({"job_id": i}) + "\n" for i in ids))
    answer_stream(spark, str(tmp_path / "jobs"), "job_id string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("r", F.lit(1))).awaitTermination()
    assert sorted(r.job_id for r in Ledger(spark, str(tmp_path / "out")).read().collect()) == ["a", "b", "c"]


def test_model_calls_retry_and_dedupe(spark):
    def factory():
        state = {"n": 0}

        def model(given):
            state["n"] += 1
            if state["n"] == 1:
                raise OSError("busy")
            return [len(x) for x in given]

        return model

    df = spark.createDataFrame([("aa",), ("aa",), ("b",)], "t string").coalesce(1)
    assert sorted(r.n for r in models.call_distinct(df, "t", "n", factory, "long", wait=0.0).collect()) == [1, 2, 2]


def test_auc_without_groups_against_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(float(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(3000)]
    won = [s for y, s in rows if y]
    lost = [s for y, s in rows if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a in won for b in lost) / (len(won) * len(lost))
    df = spark.createDataFrame(rows, "help double, p double")
    assert abs(gate.auc(df, "help", "p").first()["auc"] - expected) < 1e-5
    assert gate.auc(df.where("false"), "help", "p").count() == 0


def test_feature_sets_need_the_whole_judge_column(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "judge_yes double")
    assert list(gate.feature_sets(df)) == list(gate.feature_sets(df.drop("judge_yes"))) == ["retrieval", "no_judge"]
    assert gate.feature_sets(df.where("judge_yes > 0"))["full"][-1] == "judge_yes"


def test_gate_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 0.9, 0.5), ("a", 0.0, 0.1, 0.5), ("b", 1.0, 0.6, 0.5), ("b", None, 0.2, 0.5)], "country string, help double, p double, t double")
    sinks.report(gate.report(df, "country"), "place", "line", str(tmp_path / "out"))
    text_of = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text_of == ["AUC 1.000; kept for 50.0% of rows; help kept 100.0%, hurt kept 0.0%", "    a            AUC 1.000  kept 50.0%"]


def test_chat_client_and_judge(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(asked)
            if len(calls) == 1:
                return self.send_error(503)
            alternatives = [{"token": " yes", "logprob": -0.2876820724517809}, {"token": "No", "logprob": -1.3862943611198906}]
            made = {"response": "YES"} | ({"logprobs": [{"top_logprobs": alternatives}]} if asked["prompt"] == "a" else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(made).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = models.chat_client(f"http://127.0.0.1:{server.server_port}/", "m", logprobs=10, max_tokens=1)
        df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
        out = {r.prompt: r for r in models.judge(df, "prompt", client, wait=0.0).collect()}
    finally:
        server.shutdown()
    assert (out["a"].p_yes, out["a"].how, out["b"].p_yes, out["b"].how) == (0.75, "logprobs", 1.0, "text")
    assert len(calls) == 3 and calls[1]["options"] == {"temperature": 0, "num_predict": 1} and calls[1]["top_logprobs"] == 10


def test_normalisers_are_needed_only_where_used(spark):
    registry = {"English": text.tokens, "Upper": lambda c: F.array(F.upper(c))}
    df = spark.createDataFrame([("English", "Hot dogs"), ("Upper", "x"), ("Korean", "y"), (None, "z")], "language string, t string")
    made = df.withColumn("w", text.normalised_by(F.col("language"), F.col("t"), registry))
    assert [r.w for r in made.where(text.has_normaliser(F.col("language"), registry)).collect()] == [["hot", "dogs"], ["X"]]
    with pytest.raises(Exception, match="no normaliser for Korean"):
        made.where("language = 'Korean'").collect()


def test_golds_local_then_english(spark, tmp_path):
    notes = [{"answers": ["추러스"], "en_answers": ["Churros"], "count": 4}, {"answers": None, "en_answers": ["hot dog"], "count": 1}]
    idks = {"idk": 0, "no-answer": 0, "not-applicable": 0}
    entry = lambda **skip: {"question": "x", "en_question": "y", "annotations": notes, "idks": idks | skip}
    (tmp_path / "n.json").write_text(json.dumps({"q1": entry(), "q2": entry(idk=5), "q3": entry(**{"no-answer": 2, "not-applicable": 1})}))
    rows = readers.annotations(spark, str(tmp_path / "n.json"))
    tried = lambda local: [(r.qid, r.gold, r.votes) for r in scoring.golds(rows, ["qid"], F.lit(local)).orderBy("place").collect()]
    assert tried(True) == [("q1", "추러스", 4), ("q1", "churros", 4), ("q1", "hot dog", 1)]
    assert tried(False) == tried(None) == [("q1", "churros", 4), ("q1", "hot dog", 1)]


def test_optional_filters_and_observed_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, n int")
    assert readers.where(df, c=None, n=None).count() == 3
    assert readers.where(df, c=["a", "b"], n=2).first().c == "b"
    rows, seen = sinks.observed(df, "rows", most=F.max("n"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 3, "most": 3}


def test_judge_prompt_lists_notes(spark):
    made = one(spark, text.judge_prompt(F.col("c"), F.lit("Q"), F.array(F.lit("x"), F.lit("y"))), c="South_Korea")
    assert "life in South Korea." in made and "\n- x\n- y\n" in made
