"""Scores, roll-ups, comparisons, the answer gate and knowledge-base audits over the role views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import scores, text
from ragloom.operators import audit, crossfit, duplicates, gate, scoring

from . import roles
from .registry import Tables, query
from .roles import OUTCOMES, content, norm

OUT = f"with {OUTCOMES} "
GROUP = ["model", "country", "language", "prompt_no"]
G = ", ".join(GROUP)


@query(OUT + f"select {G}, count(*)::bigint as n_scored, round(avg(score_b), 6) as mean from outcomes where score_b is not null group by all")
def sem_group_scores(t: Tables) -> DataFrame:
    out = scoring.group_scores(roles.outcomes(t), GROUP, "score_b")
    return out.withColumn("mean", F.round("mean", 6))


@query(OUT + f", g as (select {G}, round(avg(score_b) * 100, 2) as m from outcomes where score_b is not null group by all) select model, country, round(avg(m), 6) as m from g group by all")
def sem_final_mean(t: Tables) -> DataFrame:
    """Means of rounded group means."""
    out = scoring.mean_of_means(roles.outcomes(t), [GROUP, ["model", "country"]], "score_b", 2)
    return out.withColumn("m", F.round("m", 6))


THREE = f"a as (select {G}, avg(score_b) * 100 as m from outcomes where score_b is not null group by all), b as (select model, country, language, avg(m) as m from a group by all), c as (select country, language, avg(m) as m from b group by all)"


@query(OUT + f", {THREE} select country, language, round(m, 6) as m from c")
def sem_three_level(t: Tables) -> DataFrame:
    out = scoring.mean_of_means(roles.outcomes(t), [GROUP, GROUP[:3], ["country", "language"]], "score_b")
    return out.withColumn("m", F.round("m", 6))


@query(OUT + "select model, country, qid, min(case when prompt_no = 'p0' then length(response) end)::bigint as p0, min(case when prompt_no = 'p1' then length(response) end)::bigint as p1 from outcomes group by all")
def pivot_first(t: Tables) -> DataFrame:
    rows = roles.outcomes(t).withColumn("n", F.length("response").cast("long"))
    return scoring.pivot(rows, ["model", "country", "qid"], "prompt_no", list(roles.PROMPTS), F.min("n"))


@query(OUT + "select model, round(avg(score_b) filter (where language = 'English') * 100, 4) as \"English\", round(avg(score_b) filter (where language = 'Local') * 100, 4) as \"Local\" from outcomes where score_b is not null group by model")
def sem_pivot(t: Tables) -> DataFrame:
    return scoring.pivot(roles.outcomes(t).where("score_b is not null"), ["model"], "language", ["English", "Local"], F.round(F.avg("score_b") * 100, 4))


@query(OUT + ", s as (select country, case when country < 'src15' then 'high' else 'low' end as class, avg(score_b) as b, avg(score_v) as v from outcomes where score_b is not null group by all) "
       "select country as row, round(b, 6) as b, round(v, 6) as v from s union all select 'avg ' || class, round(avg(b), 6), round(avg(v), 6) from s group by class union all select 'avg all', round(avg(b), 6), round(avg(v), 6) from s")  # fmt: skip
def subtotal_rows(t: Tables) -> DataFrame:
    per = roles.outcomes(t).where("score_b is not null").groupBy("country").agg(F.avg("score_b").alias("b"), F.avg("score_v").alias("v"))
    return scoring.with_subtotals(per.withColumn("class", F.when(F.col("country") < "src15", "high").otherwise("low")), "country", "class", ["b", "v"])


@query(OUT + "select model, topic, round(avg(score_b), 6) as accuracy from outcomes where score_b is not null group by all")
def accuracy_by_topic(t: Tables) -> DataFrame:
    return roles.outcomes(t).where("score_b is not null").groupBy("model", "topic").agg(F.round(F.avg("score_b"), 6).alias("accuracy"))


@query(OUT + "select country, " + ", ".join(f"count(*) filter (where topic = 't{i}')::bigint as t{i}" for i in range(6)) + ", count(*)::bigint as total from outcomes where score_b is not null group by country")
def scorable_by_topic(t: Tables) -> DataFrame:
    rows = roles.outcomes(t).where("score_b is not null")
    return rows.groupBy("country").agg(*[F.count_if(F.col("topic") == f"t{i}").alias(f"t{i}") for i in range(6)], F.count("*").alias("total"))


@query(f"with {OUTCOMES}, {roles.CARDS}, {roles.GOLDS}, {roles.HITS}, h as (select distinct card_id as doc_id from hits) select h.doc_id is not null as hit, count(*)::bigint as n, round(avg(score_b), 6) as accuracy from outcomes o left join h on h.doc_id = o.doc_id where score_b is not null group by all")
def accuracy_split_by_hit(t: Tables) -> DataFrame:
    hit = roles.gold_hits(t).select(F.col("card_id").alias("doc_id")).distinct().withColumn("h", F.lit(True))
    rows = roles.outcomes(t).where("score_b is not null").join(hit, "doc_id", "left").withColumn("hit", F.coalesce("h", F.lit(False)))
    return rows.groupBy("hit").agg(F.count("*").alias("n"), F.round(F.avg("score_b"), 6).alias("accuracy"))


@query(OUT + "select country, count(*) filter (where score_b = 0 and score_v = 1)::bigint as to_right, count(*) filter (where score_b = 1 and score_v = 0)::bigint as to_wrong, count(*) filter (where score_b = score_v)::bigint as same from outcomes group by country")
def flip_counts(t: Tables) -> DataFrame:
    return scoring.flips(roles.outcomes(t), ["country"], "score_b", "score_v")


@query(OUT + "select country, count(*) filter (where score_v > score_b)::bigint as help, count(*) filter (where score_v < score_b)::bigint as hurt, round(avg(greatest(score_b, score_v)), 6) as perfect from outcomes where score_b is not null group by country")
def help_hurt_table(t: Tables) -> DataFrame:
    rows = roles.outcomes(t).where("score_b is not null").withColumn("h", gate.help_label(F.col("score_b"), F.col("score_v")))
    best = gate.best_of_two(F.col("score_b"), F.col("score_v"))
    return rows.groupBy("country").agg(F.count_if(F.col("h") == 1).alias("help"), F.count_if(F.col("h") == 0).alias("hurt"), F.round(F.avg(best), 6).alias("perfect"))


@query("select lang, round(avg((regexp_matches(lower(text), 'that (is|was|are)|license'))::int), 6) as rate from documents group by lang")
def refusal_rate(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.round(F.avg(F.lower("text").rlike("that (is|was|are)|license").cast("int")), 6).alias("rate"))


@query("select lang, quantile_cont(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')), 0.5)::double as median from documents group by lang")
def median_answer_len(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.percentile(text.word_count(F.col("text")), 0.5).alias("median"))


@query(OUT + "select country, round(avg((p < 0.05 or p > 0.95)::int), 6) as sure, round(avg((p > 0.5)::int), 6) as yes from outcomes group by country")
def judge_confidence(t: Tables) -> DataFrame:
    p = F.col("p")
    return roles.outcomes(t).groupBy("country").agg(F.round(F.avg(((p < 0.05) | (p > 0.95)).cast("int")), 6).alias("sure"), F.round(F.avg((p > 0.5).cast("int")), 6).alias("yes"))


@query(OUT + ", s as (select model, country, avg(score_b) * 100 as b, avg(score_v) * 100 as v, avg(case when p > 0.5 then score_v else score_b end) * 100 as g from outcomes where score_b is not null group by all) select model, country, round(b, 4) as baseline, round(v - b, 4) as d_v1, round(g - b, 4) as d_v2 from s")
def three_way_delta(t: Tables) -> DataFrame:
    o = roles.outcomes(t).where("score_b is not null")
    gated = F.when(gate.decide(F.col("p"), F.lit(0.5)), F.col("score_v")).otherwise(F.col("score_b"))
    s = o.groupBy("model", "country").agg(*[(F.avg(c) * 100).alias(n) for c, n in ((F.col("score_b"), "b"), (F.col("score_v"), "v"), (gated, "g"))])
    return s.select("model", "country", F.round("b", 4).alias("baseline"), F.round(F.col("v") - F.col("b"), 4).alias("d_v1"), F.round(F.col("g") - F.col("b"), 4).alias("d_v2"))


@query(OUT + ", s as (select model, country < 'src15' as high, avg(score_b) as m from outcomes where score_b is not null group by all) select model, round(max(case when high then m end) - max(case when not high then m end), 6) as gap from s group by model")
def resource_gap(t: Tables) -> DataFrame:
    s = roles.outcomes(t).where("score_b is not null").withColumn("high", F.col("country") < "src15").groupBy("model", "high").agg(F.avg("score_b").alias("m"))
    return s.groupBy("model").agg(F.round(F.max(F.when(F.col("high"), F.col("m"))) - F.max(F.when(~F.col("high"), F.col("m"))), 6).alias("gap"))


SKIP = "not ((item_id % 4 + item_id % 3 >= 3) or item_id % 7 >= 5)"
SOFT = f"""with i as (select item_id, text, row_number() over (order by item_id) - 1 as place from benchmark),
g as (select item_id, place, list_sort(list_distinct({roles.tok('text')})) as w from i where {SKIP}),
b as (select count(*) as n from benchmark),
v as (select conv_id, turn, {norm('text')} as response, list_distinct({roles.tok('text')}) as lemmas, conv_id % n as place from conversations cross join b),
p as (select conv_id, turn, unnest(range(0, (len(w) + 1) // 2)) as i, w, lemmas, response from v join g using (place)),
q as (select conv_id, turn, 1 + i % 5 as votes, w[i * 2 + 1 : i * 2 + 2] as gl, lemmas, response from p),
m as (select conv_id, turn, votes, (contains(response, array_to_string(gl, ' ')) or len(list_intersect(lemmas, gl)) = len(gl))::int as hit from q)
select conv_id, turn, max(hit)::bigint as sem_b, round(max(case when hit = 1 then votes else 0 end)::double / max(votes), 6) as sem_w from m group by all"""


@query(SOFT)
def soft_exact_match(t: Tables) -> DataFrame:
    """Answers are conversation turns, golds all pairs of a benchmark item's sorted words; base forms are lower-cased words. Items that
    the skip filter rules out (their annotators' counts are made up from the id) have no scored answers."""
    item = F.col("item_id")
    place = F.row_number().over(Window.orderBy("item_id")) - 1  # answers go round all items of the benchmark
    items = t.benchmark.select("item_id", "text", place.cast("long").alias("place"))
    n = max(1, items.count())
    words = F.array_sort(F.array_distinct(text.tokens(F.col("text"))))
    g = items.where(scoring.scorable(item % 4, item % 3, item % 7, F.lit(1))).select("place", words.alias("w")).where("size(w) > 0")
    pair = F.transform(F.sequence(F.lit(0), F.expr("(size(w) + 1) div 2 - 1")), lambda i: F.struct((1 + i % 5).alias("votes"), F.slice("w", (2 * i + 1).cast("int"), F.lit(2)).alias("gold_lemmas")))
    g = g.select("place", F.explode(pair).alias("x")).select("place", "x.votes", "x.gold_lemmas", F.array_join("x.gold_lemmas", " ").alias("gold"))
    a = t.conversations.select("conv_id", "turn", F.pmod("conv_id", F.lit(n)).alias("place"), text.normalize(F.col("text")).alias("response"), text.tokens(F.col("text")).alias("lemmas"))
    golds = a.select("conv_id", "turn", "place").join(g, "place").drop("place")
    out = scoring.soft_exact_match(a.drop("place"), golds, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("sem_b").cast("long").alias("sem_b"), F.round("sem_w", 6).alias("sem_w"))


# The gate
HELP = "help as (select *, case when score_b is null or score_v is null or score_b = score_v then null else (score_v > score_b)::int::double end as help from outcomes)"
GATE = f"with {OUTCOMES}, {HELP} "


def _labelled(t: Tables) -> DataFrame:
    return roles.outcomes(t).withColumn("help", gate.help_label(F.col("score_b"), F.col("score_v")))


@query(GATE + "select doc_id, help from help")
def help_label(t: Tables) -> DataFrame:
    return _labelled(t).select("doc_id", "help")


@query(GATE + "select doc_id, p > 0.5 as use from help")
def gate_decision(t: Tables) -> DataFrame:
    return _labelled(t).select("doc_id", gate.decide(F.col("p"), F.lit(0.5)).alias("use"))


@query(GATE + "select doc_id, case when p > 0.5 then score_v else score_b end as score from help")
def gate_select_score(t: Tables) -> DataFrame:
    decided = _labelled(t).where(gate.decide(F.col("p"), F.lit(0.5))).select("doc_id", F.col("score_v").alias("s"))
    base = roles.outcomes(t).select("doc_id", F.col("score_b").alias("score"))
    return gate.overlay(base, decided, ["doc_id"])


@query(GATE + "select doc_id, greatest(score_b, score_v)::double as best from help")
def oracle_gate_greatest(t: Tables) -> DataFrame:
    return _labelled(t).select("doc_id", gate.best_of_two(F.col("score_b"), F.col("score_v")).alias("best"))


AUC = ", r as (select *, rank() over ({part} order by p) + (count(*) over ({part2} p) - 1) / 2.0 as rk from help where help is not null), s as (select {keys} sum(help) as n1, sum(1 - help) as n0, sum(case when help = 1 then rk end) as r from r {group}) select {keys} round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6)::double as auc from s where n1 > 0 and n0 > 0"


@query(GATE + AUC.format(part="", part2="partition by", keys="", group=""))
def roc_auc_exact(t: Tables) -> DataFrame:
    return gate.auc(_labelled(t), "help", "p")


@query(GATE + AUC.format(part="partition by country", part2="partition by country,", keys="country,", group="group by country"))
def roc_auc_by_group(t: Tables) -> DataFrame:
    return gate.auc(_labelled(t), "help", "p", ["country"])


@query(GATE + ", g as (select i as pos, (30 + 5 * i) / 100.0::double as t from range(0, 9) r(i)) select pos, t, sum(case when p > t then 2 * help - 1 else 0 end)::bigint as gain from help cross join g where help is not null group by all")
def gate_gain_by_threshold(t: Tables) -> DataFrame:
    grid = t.spark.range(9).selectExpr("id as pos", "(30 + 5 * id) / 100.0D as t")
    return gate.gains(_labelled(t), grid)


@query(GATE + "select round(avg((p > 0.5)::int), 6) as kept, round(avg(case when help = 1 then (p > 0.5)::int end), 6) as help_kept, round(avg(case when help = 0 then (p > 0.5)::int end), 6) as hurt_kept from help")
def kept_rates(t: Tables) -> DataFrame:
    use = gate.decide(F.col("p"), F.lit(0.5)).cast("int")
    h = F.col("help")
    return _labelled(t).agg(
        F.round(F.avg(use), 6).alias("kept"), F.round(F.avg(F.when(h == 1, use)), 6).alias("help_kept"), F.round(F.avg(F.when(h == 0, use)), 6).alias("hurt_kept")
    )


@query("select distinct doc_id // 40 as template, (('0x' || substr(md5((doc_id // 40)::varchar), 1, 8))::bigint % 5)::int as fold from documents")
def group_kfold_assign(t: Tables) -> DataFrame:
    return roles.outcomes(t).select(F.col("qid").alias("template")).distinct().withColumn("fold", gate.hash_folds(F.col("template"), 5))


@query(OUT + ", f as (select country, (('0x' || substr(md5(qid::varchar), 1, 8))::bigint % 5)::int as fold from outcomes) select test_fold, test_part, count(*) filter (where fold <> test_fold and country <> test_part)::bigint as train, count(*) filter (where fold = test_fold and country = test_part)::bigint as test from f cross join (select i::int as test_fold from range(0, 5) r(i)) cross join (select distinct country as test_part from outcomes) group by all")
def loco_splits(t: Tables) -> DataFrame:
    rows = roles.outcomes(t).select("country", gate.hash_folds(F.col("qid"), 5).alias("fold"))
    rows = gate.loco(rows, "fold", "country", 5)
    return rows.groupBy("test_fold", "test_part").agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"))


@query("select doc_id, round((n_chars - avg(n_chars) over ()) / stddev_pop(n_chars) over (), 6) as n_chars_scaled from documents")
def standard_scale(t: Tables) -> DataFrame:
    out = gate.population_scale(t.documents.select("doc_id", "n_chars"), ["n_chars"])
    return out.select("doc_id", F.round("n_chars_scaled", 6).alias("n_chars_scaled"))


@query("select quality, round(sum(count(*)) over () / (2.0 * count(*)), 6)::double as weight, count(*)::bigint as n from labels group by quality")
def class_weights(t: Tables) -> DataFrame:
    out = gate.class_weights(t.labels, "quality")
    return out.groupBy("quality").agg(F.round(F.max("weight").cast("double"), 6).alias("weight"), F.count("*").alias("n"))


FEATURES = f"""with {OUTCOMES}, {HELP},
pair as (select a.doc_id, a.model, a.country, a.language, a.topic, a.qid, a.prompt_no, a.p, a.help, a.response as rb, b.response as rv
    from help a join outcomes b on a.country = b.country and a.qid = b.qid and a.prompt_no = 'p0' and b.prompt_no = 'p1'),
ag as (select model, country, qid, (min(case when prompt_no = 'p0' then {norm('response')} end) = min(case when prompt_no = 'p1' then {norm('response')} end))::int as agree
    from outcomes group by all),
c as (select pair.*, coalesce(agree, 0) as agree, [p, p / 2, p / 4] as r, {content('rb')} as wb, {content('rv')} as wv, {content("country || ' ' || rv")} as wc from pair left join ag using (model, country, qid))
select doc_id, agree::bigint as base_agree, len(regexp_extract_all(rb, '\\S+'))::bigint as base_len, len(regexp_extract_all(rv, '\\S+'))::bigint as rag_len, round(p, 6) as r_max, round((p + p / 2 + p / 4) / 3, 6) as r_mean, round(p / 4, 6) as r_min, round(p - p / 2, 6) as r_gap, 3::bigint as n_cards,
    round({roles.share('wb', 'wc')}, 6) as base_in_cards, round({roles.share('wv', 'wc')}, 6) as rag_in_cards, ({norm('rb')} <> {norm('rv')})::bigint as changed,
    round({roles.share('wv', 'wb')}, 6) as rag_base_overlap, (language = 'English')::bigint as is_english, help from c"""


def gate_rows(t: Tables) -> DataFrame:
    o = _labelled(t)
    a = o.where("prompt_no = 'p0'").select("doc_id", "model", "country", "language", "topic", "qid", "p", "help", F.col("response").alias("rb"))
    b = o.where("prompt_no = 'p1'").select("country", "qid", F.col("response").alias("rv"))
    agree = gate.agreement(o, ["model", "country", "qid"], "prompt_no", "p0", "p1").withColumnRenamed("agree", "base_agree")
    rows = a.join(b, ["country", "qid"]).join(agree, ["model", "country", "qid"], "left").withColumn("r", F.array(F.col("p"), F.col("p") / 2, F.col("p") / 4))
    f = gate.score_features(F.col("r")) | gate.answer_features(F.col("rb"), F.col("rv"), F.concat_ws(" ", "country", "rv"))
    return rows.select("doc_id", "model", "country", "topic", "qid", "help", F.coalesce("base_agree", F.lit(0)).alias("base_agree"), (F.col("language") == "English").cast("long").alias("is_english"), *[c.alias(k) for k, c in f.items()])


@query(FEATURES)
def gate_features(t: Tables) -> DataFrame:
    rows = gate_rows(t)
    real = ["r_max", "r_mean", "r_min", "r_gap", "base_in_cards", "rag_in_cards", "rag_base_overlap"]
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in real], *[F.col(c).cast("long").alias(c) for c in ("n_cards", "changed", "is_english", "base_agree", "base_len", "rag_len")], "help")


PACKED = 16
NUMERIC = ["r_max", "r_gap", "base_in_cards", "rag_in_cards", "rag_base_overlap", "is_english"]


def _train_rows(t: Tables) -> DataFrame:
    """Every labelled row with some numbers to learn from; the label is the document's quality."""
    rows = t.documents.join(t.labels, "doc_id").selectExpr(
        "doc_id", "cast(quality as double) as help", "doc_id div 40 as template", "log(1 + n_chars) as len", "(doc_id * 37 % 101) / 100.0D as p0",
        "cast(lang = 'en' as double) as is_english", "lang",
    )
    share = F.size(F.array_distinct(text.tokens(F.col("text")))) / F.greatest(F.size(text.tokens(F.col("text"))), F.lit(1))
    extra = t.documents.select("doc_id", share.alias("variety"))
    return rows.join(extra, "doc_id")


GATE_NUMBERS, GATE_CATEGORIES = ["len", "variety", "is_english"], ["lang"]


@query(None)
def gate_logreg(t: Tables) -> DataFrame:
    rows = _train_rows(t)
    return crossfit.fit_all(rows, GATE_NUMBERS, GATE_CATEGORIES, crossfit.Linear()).select("doc_id", F.round("p", 6).alias("p"))


@query(None)
def gate_gbt(t: Tables) -> DataFrame:
    rows = _train_rows(t)
    model = gate.fit(rows, "gbt", GATE_NUMBERS, GATE_CATEGORIES)
    return gate.predict(model, rows).select("doc_id", F.round("p", 6).alias("p"))


@query(None)
def gate_crossfit(t: Tables) -> DataFrame:
    out = crossfit.cross_fit(_train_rows(t), GATE_NUMBERS, GATE_CATEGORIES)
    return out.select("doc_id", "help", F.round("p", 6).alias("p"), "t", gate.decide(F.col("p"), F.col("t")).alias("use"))


@query(None)
def gate_loco(t: Tables) -> DataFrame:
    """Models that have seen neither a row's template nor its language."""
    out = crossfit.cross_fit(_train_rows(t), GATE_NUMBERS, [], part="lang")
    return out.select("doc_id", "lang", "help", F.round("p", 6).alias("p"), "t", gate.decide(F.col("p"), F.col("t")).alias("use"))


@query(f"""with recursive s as (select n_chars // 100 as template, count(*)::bigint as n from documents group by 1),
r as (select *, row_number() over (order by n desc, template) as i from s),
h(i, loads, fold) as (select 0::bigint, [0, 0, 0, 0, 0]::bigint[], null::int union all
  select h.i + 1, list_transform(range(1, 6), lambda j: loads[j] + case when j = list_position(loads, list_min(loads)) then r.n else 0 end), (list_position(loads, list_min(loads)) - 1)::int
  from h join r on r.i = h.i + 1 where h.i < {PACKED}),
x as (select template, (sum(n) over (order by b, template) - n)::bigint as start from (select *, ('0x' || substr(md5(template::varchar), 1, 8))::bigint % {gate.STRETCHES} as b from r where i > {PACKED})),
l as (select loads, (select coalesce(sum(n), 0) from r where i > {PACKED})::bigint as total from h order by i desc limit 1),
v as (select list_transform(loads, lambda load: greatest(0.0, list_min(list_transform(range(1, 6), lambda m: (total + list_sum(list_sort(loads)[1:m])) / m)) - load)) as lacks from l),
e as (select list_transform(range(1, 6), lambda j: list_sum(lacks[1:j])) as ends from v)
select r.template, fold from h join r using (i) union all select template, least(4, len(list_filter(ends, lambda y: y <= start)))::int from x cross join e""")
def group_kfold_balanced(t: Tables) -> DataFrame:
    return gate.balanced_folds(t.documents.selectExpr("n_chars div 100 as template"), "template", 5, PACKED)


# Audits
HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"


@query(f"with {roles.CARDS}, n as (select category, count(*) as n from cards group by category) select k.category, coalesce(n, 0)::bigint as n, greatest(170 - coalesce(n, 0), 0)::bigint as shortfall from (values ('c0'), ('c1'), ('c2'), ('c3'), ('c4'), ('c5'), ('c6')) as k(category) left join n using (category)")
def kb_category_shortfall(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(f"c{i}",) for i in range(7)], "category string")
    return audit.shortfall(roles.cards(t), names, "category", 170)


@query(f"with h as (select {HOST} as host, count(*) as n from pages group by all) select host, n::bigint as n, round(n::double / sum(n) over (), 6) as share from h")
def kb_domain_share(t: Tables) -> DataFrame:
    return audit.shares(t.pages.select(audit.host(F.col("url")).alias("host")), "host")


@query(f"select 'c' || (page_id % 6) as category, {HOST} as host, count(*)::bigint as n from pages group by all")
def kb_category_domain(t: Tables) -> DataFrame:
    return t.pages.select(F.expr("concat('c', page_id % 6)").alias("category"), audit.host(F.col("url")).alias("host")).groupBy("category", "host").agg(F.count("*").alias("n"))


@query(f"select 'c' || (page_id % 6) as category, count(distinct {HOST})::bigint as hosts, count(distinct {HOST}) >= 2 as ok from pages group by all")
def kb_min_domains_rule(t: Tables) -> DataFrame:
    rows = t.pages.select(F.expr("concat('c', page_id % 6)").alias("category"), audit.host(F.col("url")).alias("host"))
    return rows.groupBy("category").agg(F.count_distinct("host").alias("hosts")).withColumn("ok", F.col("hosts") >= 2)


@query(f"with {roles.CARDS}, u as (select 'language' as metric, language as value from cards union all select 'country', country from cards union all select 'category', category from cards) select metric, value, count(*)::bigint as n from u group by all")
def kb_profile_unpivot(t: Tables) -> DataFrame:
    return audit.profile(roles.cards(t), ["language", "country", "category"])


@query("select value, count(*)::bigint as n from (select unnest(string_split(lang || '; ' || source, '; ')) as value from documents) group by value")
def kb_multivalue_explode(t: Tables) -> DataFrame:
    return audit.multi_valued(t.documents.select(F.concat_ws("; ", "lang", "source").alias("v")), "v")


RULES = f"""select 'unique ids' as rule, case when count(*) = count(distinct doc_id) then 'PASS' else 'FAIL' end as verdict from documents
union all select 'required fields', case when count(*) = count(text) and count(*) = count(lang) then 'PASS' else 'FAIL' end from documents
union all select 'direct urls', case when bool_and(url like 'http%') then 'PASS' else 'FAIL' end from pages
union all select 'host share', case when max(n) <= 0.2 * sum(n) then 'PASS' else 'FAIL' end from (select count(*) as n from pages group by {HOST})"""


@query(RULES)
def kb_quality_rules(t: Tables) -> DataFrame:
    d, p = t.documents, t.pages
    hosts = p.groupBy(audit.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return audit.rules(
        {
            "unique ids": d.agg((F.count("*") == F.count_distinct("doc_id")).alias("ok")),
            "required fields": d.agg(((F.count("*") == F.count("text")) & (F.count("*") == F.count("lang"))).alias("ok")),
            "direct urls": p.agg(F.bool_and(F.col("url").startswith("http")).alias("ok")),
            "host share": hosts.agg((F.max("n") <= 0.2 * F.sum("n")).alias("ok")),
        }
    )


@query(f"select prefix, count(*)::bigint as n, min(doc_id) as first_id from (select substr({norm('text')}, 1, 80) as prefix, doc_id from documents) group by prefix having count(*) > 1")
def kb_prefix_duplicates(t: Tables) -> DataFrame:
    return audit.prefix_duplicates(t.documents, "text", "doc_id")


URL_PARTS = r"regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)', {i})"
PLAIN = r"""array_to_string(list_transform(string_split({x}, '%'), lambda p, i: case when i = 1 then p when not regexp_matches(p, '^[0-9A-Fa-f]{{2}}') then '%' || p
    when regexp_matches(chr(('0x' || p[1:2])::int), '^[A-Za-z0-9._~-]$') then chr(('0x' || p[1:2])::int) || p[3:] else '%' || upper(p[1:2]) || p[3:] end), '')"""
TITLE = "nullif(regexp_extract(html, '<title>([^<]*)', 1), '')"
CLASSES = f"""with recursive p as (select page_id, lower({URL_PARTS.format(i=1)}) as s, lower({URL_PARTS.format(i=2)}) as a, {URL_PARTS.format(i=3)} as path, {URL_PARTS.format(i=4)} as q, {TITLE} as title from pages),
c as (select page_id, title, s || '://' || case when s = 'http' and a like '%:80' then a[:-4] when s = 'https' and a like '%:443' then a[:-5] else regexp_replace(a, ':$', '') end as site,
    case when path = '' then '/' else {PLAIN.format(x='path')} end as path, array_to_string(list_sort(list_filter(string_split({PLAIN.format(x='q')}, '&'), lambda x: x <> '')), '&') as q from p where s <> ''),
k as (select page_id, 'url' as rule, site || path || case when q = '' then '' else '?' || q end as value from c union all select page_id, 'place', site || path from c
    union all select page_id, 'title', {TITLE} || '|' || length(html) // 500 from pages where {TITLE} is not null),
e as (select distinct x.page_id as a, y.page_id as b from k x join k y using (rule, value)),
r as (select page_id as a, page_id as b from pages union select r.a, e.b from r join e on r.b = e.a)
select a as page_id, min(b) as class_id from r group by a"""


@query(CLASSES)
def kb_duplicate_classes(t: Tables) -> DataFrame:
    """Pages that share their address, their address without parameters, or their title at about the same length."""
    url = duplicates.canonical_url(F.col("url"))
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    titled = F.when(title != "", F.concat(title, F.lit("|"), F.expr("cast(length(html) div 500 as string)")))
    return duplicates.classes(t.pages, "page_id", {"url": url, "place": F.regexp_extract(url, r"^[^?]*", 0), "title": titled})


@query(f"with {roles.CARDS}, {roles.GOLDS}, {roles.HITS} select country, count(distinct item_id)::bigint as covered from hits group by country")
def coverage_distinct(t: Tables) -> DataFrame:
    return roles.gold_hits(t).groupBy("country").agg(F.count_distinct("item_id").alias("covered"))
