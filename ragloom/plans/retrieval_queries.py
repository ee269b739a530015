"""Retrieval: lexical and dense scores, fusion, cascades, diagnostics and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import models, scores, text
from ragloom.operators import blocked, mentions, retrieval, tuning

from . import roles
from .registry import Tables, query

KEYS = ["country", "item_id"]
TAUS = "taus as (select i - 1 as pos, i * 5 / 100.0::double as tau from range(1, 20) r(i))"
ALPHAS = "alphas as (select i as pos, i * 10 / 100.0::double as alpha from range(0, 11) r(i))"


def _taus(t: Tables) -> DataFrame:
    return t.spark.range(1, 20).selectExpr("id - 1 as pos", "id * 5 / 100.0D as tau")


def _alphas(t: Tables) -> DataFrame:
    return t.spark.range(0, 11).selectExpr("id as pos", "id * 10 / 100.0D as alpha")


DENSE_TOP = """with unit as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u from embeddings),
s as (select q.label, q.vec_id, c.vec_id as card_id, round(list_inner_product(q.u, c.u), 6) as score from unit q join unit c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 10 = 0),
r as (select *, row_number() over (partition by label, vec_id order by score desc, card_id) as rank from s)
select label, vec_id, card_id, score, rank from r where rank <= 3"""


@query(DENSE_TOP)
def dense_cosine_topk(t: Tables) -> DataFrame:
    """Region-restricted dense top 3: queries are every tenth vector, cards the others of its label."""
    q = t.embeddings.where("vec_id % 10 = 0").select("label", "vec_id", "embedding")
    c = t.embeddings.select("label", F.col("vec_id").alias("card_id"), "embedding")
    near = blocked.scored(q, c, 3, "label", "vec_id", vector="embedding", terms=None, others=True).withColumnRenamed("dense", "score")
    top = retrieval.top_k(near, 3, ["label", "vec_id"], "score")
    return top.select("label", "vec_id", "card_id", "score", F.col("rank").cast("long").alias("rank"))


@query("select vec_id, round(sum(x * x), 6) as square from (select vec_id, unnest(list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])))) as x from embeddings) group by vec_id")
def l2_normalize(t: Tables) -> DataFrame:
    u = scores.l2_normalize(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(scores.dot(u, u), 6).alias("square"))


@query(f"with {roles.CARDS}, {roles.QUESTIONS}, {roles.BM25} select country, item_id, card_id, bm25 from bm25")
def bm25_scores(t: Tables) -> DataFrame:
    return roles.bm25_scores(t)


@query(f"with {roles.GRID} select country, item_id, card_id, dense, bm25 from graded")
def region_cross_score(t: Tables) -> DataFrame:
    """Every question against every card of its region."""
    return roles.cross_scores(t).select(*KEYS, "card_id", "dense", "bm25")


@query(f"with {roles.GRID} select country, item_id, card_id, round(dn, 6) as dn, round(ln, 6) as ln from graded")
def minmax_per_query(t: Tables) -> DataFrame:
    return roles.graded(t).select(*KEYS, "card_id", F.round("dn", 6).alias("dn"), F.round("ln", 6).alias("ln"))


@query(f"with {roles.GRID}, {roles.HYBRID} select country, item_id, card_id, hybrid from fused")
def hybrid_fusion(t: Tables) -> DataFrame:
    return retrieval.hybrid(roles.graded(t)).select(*KEYS, "card_id", "hybrid")


@query(f"with {roles.GRID} select country, item_id, max(dense) as max_dense, max(bm25) as max_bm25 from graded group by all")
def max_score_per_query(t: Tables) -> DataFrame:
    return roles.extremes(t).select(*KEYS, "max_dense", "max_bm25")


@query(f"with {roles.GRID}, {roles.HYBRID}, {roles.TOP} select country, item_id, card_id, hybrid, place as rank from placed where place <= 3")
def topk_per_query(t: Tables) -> DataFrame:
    return retrieval.top_k(retrieval.hybrid(roles.survivors(t, 3)), 3, KEYS, "hybrid").select(*KEYS, "card_id", "hybrid", F.col("rank").cast("long").alias("rank"))


@query(f"with {roles.GRID}, {roles.HYBRID}, {roles.TOP} select country, item_id, card_id, place from placed where place <= 20")
def top20_candidates(t: Tables) -> DataFrame:
    return retrieval.top_k(retrieval.hybrid(roles.survivors(t, 20)), 20, KEYS, "hybrid", out="place").select(*KEYS, "card_id", F.col("place").cast("long").alias("place"))


V1 = f"""with {roles.GRID}, {roles.HYBRID}, {roles.TOP}, m as (select country, item_id, max(dense) as max_dense, max(bm25) as max_bm25 from graded group by all)
select country, item_id, max_dense, max_bm25, string_agg(card_id || ':' || round(hybrid * 1000000)::bigint, ' ' order by place) as cards
from placed join m using (country, item_id) where place <= 3 group by all"""


@query(V1)
def retrieve_v1(t: Tables) -> DataFrame:
    out = retrieval.v1(roles.survivors(t, 3))
    spell = F.transform("cards", lambda c: F.concat(c["card_id"].cast("string"), F.lit(":"), F.round(c["hybrid"] * 1000000).cast("long").cast("string")))
    return out.withColumn("cards", F.array_join(spell, " "))


@query(f"with {roles.GRID}, r as (select *, row_number() over (partition by country, item_id order by dense desc, card_id) as rd, row_number() over (partition by country, item_id order by bm25 desc, card_id) as rl from graded), s as (select *, round(1.0::double / (60 + rd) + 1.0::double / (60 + rl), 9) as rrf from r), p as (select *, row_number() over (partition by country, item_id order by rrf desc, card_id) as rank from s) select country, item_id, card_id, rrf, rank from p where rank <= 3")
def rrf_fusion(t: Tables) -> DataFrame:
    """Only cards that can be on top are ranked; their ranks count all cards."""
    fused = retrieval.fused_ranks(roles.ranked(t, 3))
    return retrieval.top_k(fused, 3, KEYS, "rrf").select(*KEYS, "card_id", "rrf", F.col("rank").cast("long").alias("rank"))


SWEEP = f"""with {roles.GRID}, {roles.GOLDS}, {roles.HITS}, {ALPHAS},
f as (select pos, alpha, country, item_id, card_id, round(alpha * dn + (1.0 - alpha) * ln, 6) as hybrid from graded cross join alphas),
p as (select *, row_number() over (partition by pos, country, item_id order by hybrid desc, card_id) as rank from f),
q as (select pos, alpha, p.country, p.item_id, max(case when h.gold then 1.0 else 0.0 end) as hit from p left join hits h using (country, item_id, card_id) where rank <= {{k}} group by all)"""


@query(SWEEP.replace("{k}", "3") + " select pos, alpha, country, round(avg(hit::double), 6) as hit_rate from q group by all")
def fusion_sweep(t: Tables) -> DataFrame:
    """Hit rate of the top 3 per region and fusion weight: only cards that can be on top at some weight meet the weights."""
    fused = retrieval.hybrid(roles.survivors(t, 3).crossJoin(F.broadcast(_alphas(t))), F.col("alpha"))
    top = retrieval.top_k(fused, 3, ["pos", "alpha", *KEYS], "hybrid").select("pos", "alpha", *KEYS, "card_id")
    hit = roles.with_gold(t, top, 33).groupBy("pos", "alpha", *KEYS).agg(F.max(F.when(F.col("gold"), 1.0).otherwise(0.0)).alias("hit"))
    return hit.groupBy("pos", "alpha", "country").agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


@query(SWEEP.replace("{k}", "20") + f" select pos, alpha, round(avg(hit::double), 6) as recall from q where country in {roles.DEV} group by all")
def recall_at_20(t: Tables) -> DataFrame:
    dev = roles.survivors(t, 20, roles.DEV)
    return tuning.alphas(dev, roles.gold_hits(t), _alphas(t), KEYS)


@query(SWEEP.replace("{k}", "20") + f", r as (select pos, alpha, round(avg(hit::double), 6) as recall from q where country in {roles.DEV} group by all) select alpha, recall from r order by recall desc, pos limit 1")
def tune_alpha(t: Tables) -> DataFrame:
    return tuning.first_best(recall_at_20(t), "alpha", "recall")


@query(f"with {roles.CARDS}, {roles.GOLDS}, {roles.HITS} select country, item_id, card_id from hits")
def gold_mention_join(t: Tables) -> DataFrame:
    return roles.gold_hits(t).select(*KEYS, "card_id")


PHRASES = r"[\p{L}\p{N}_]+, [\p{L}\p{N}_]+|[\p{L}]{9,}"  # two words with a comma between, and long words


@query(f"""with g as (select distinct item_id, unnest(regexp_extract_all(lower(text), '{PHRASES}')) as gold from benchmark), p as (select distinct gold from g), d as (select doc_id, lower(text) as t from documents),
h as (select gold, doc_id from p join d on contains(t, gold) where case when contains(t, gold) then regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(gold) || '($|[^\\p{{L}}\\p{{N}}_])') else false end)
select item_id, gold, count(*)::bigint as n_cards, min(doc_id) as first_card from g join h using (gold) group by all""")
def gold_phrase_mentions(t: Tables) -> DataFrame:
    """Golds of several lengths, marks inside them included, and how many cards mention each as whole words."""
    golds = t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PHRASES), F.lit(0)))).alias("gold"))
    found = mentions.mentions(roles.cards(t), golds, ["card_id"], "text_en")
    return found.groupBy("item_id", "gold").agg(F.count("*").alias("n_cards"), F.min("card_id").alias("first_card"))


HIT_AT = f"""with {roles.GRID}, {roles.HYBRID}, {roles.TOP}, {roles.GOLDS}, {roles.HITS},
q as (select country, item_id, max(case when place = 1 and gold then 1 else 0 end) as h1, max(case when gold then 1 else 0 end) as h3
    from placed left join hits using (country, item_id, card_id) where place <= 3 group by all)"""


@query(HIT_AT + " select country, count(*)::bigint as n, round(avg(h1::double), 6) as hit1, round(avg(h3::double), 6) as hit3 from q group by country")
def answer_hit_at_k(t: Tables) -> DataFrame:
    top = retrieval.top_k(retrieval.hybrid(roles.survivors(t, 3)), 3, KEYS, "hybrid")
    top = roles.with_gold(t, top, 3)
    per = top.groupBy(*KEYS).agg(F.max(F.when((F.col("rank") == 1) & F.col("gold"), 1).otherwise(0)).alias("h1"), F.max(F.when(F.col("gold"), 1).otherwise(0)).alias("h3"))
    return per.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("h1"), 6).alias("hit1"), F.round(F.avg("h3"), 6).alias("hit3"))


@query(f"with {roles.RETRIEVED} select country, item_id, card_id, place from candidates")
def candidate_pairs(t: Tables) -> DataFrame:
    return roles.candidates(t).select(*KEYS, "card_id", F.col("place").cast("long").alias("place"))


@query(f"with {roles.RETRIEVED} select country, item_id, card_id, rerank, rank from candidates")
def rerank_standin(t: Tables) -> DataFrame:
    return roles.candidates(t).select(*KEYS, "card_id", "rerank", F.col("rank").cast("long").alias("rank"))


@query(f"with {roles.RETRIEVED} select country, item_id, card_id, rerank, rank from candidates where rank <= 3 and rerank >= 0.05")
def rerank_cutoff(t: Tables) -> DataFrame:
    return retrieval.cut(roles.candidates(t), 0.05).select(*KEYS, "card_id", "rerank", F.col("rank").cast("long").alias("rank"))


F05 = f"""with {roles.RETRIEVED}, {roles.GOLDS}, {roles.HITS}, {TAUS},
lab as (select c.*, coalesce(h.gold, false) as gold from candidates c left join hits h using (country, item_id, card_id) where c.country in {roles.DEV}),
per as (select pos, tau, country, item_id, count(*) filter (where rank <= 3 and rerank >= tau and gold) as tp,
    count(*) filter (where rank <= 3 and rerank >= tau and not gold) as fp, bool_or(gold) as any_gold from lab cross join taus group by all),
tot as (select pos, tau, sum(tp)::bigint as tp, sum(fp)::bigint as fp, count(*) filter (where any_gold and tp = 0)::bigint as fn from per group by all),
pr as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp::double / (tp + fn) else 0.0 end as r from tot),
fs as (select pos, tau, tp, fp, fn, round(case when 0.25 * p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0.0 end, 6) as f from pr)"""


@query(F05 + " select pos, tau, tp, fp, fn, f from fs")
def f05_by_tau(t: Tables) -> DataFrame:
    dev = roles.candidates(t, regions=roles.DEV).join(roles.gold_hits(t), [*KEYS, "card_id"], "left")
    return tuning.f_by_threshold(dev.withColumn("gold", F.coalesce("gold", F.lit(False))), _taus(t), KEYS)


@query(F05 + " select tau, f from fs order by f desc, pos limit 1")
def tune_tau(t: Tables) -> DataFrame:
    return tuning.first_best(f05_by_tau(t), "tau", "f")


@query("select max_by(quarter, (n, -quarter)) as quarter, max(n)::bigint as n from (select month(o_orderdate)::bigint as quarter, count(*) as n from orders group by all)")
def argmax_first_tie(t: Tables) -> DataFrame:
    """The first of the best on a grid: here the month with most orders."""
    n = t.orders.groupBy(F.month("o_orderdate").cast("long").alias("quarter")).agg(F.count("*").alias("n"))
    return tuning.first_best(n.withColumn("pos", F.col("quarter")), "quarter", "n")


@query(f"with {roles.RETRIEVED} select q.country, q.item_id, count(c.card_id)::bigint as n_cards, coalesce(string_agg(c.card_id::varchar, ' ' order by rank), '') as cards from questions q left join candidates c on q.country = c.country and q.item_id = c.item_id and rank <= 3 and rerank >= 0.05 group by all")
def retrieve_v2(t: Tables) -> DataFrame:
    out = retrieval.v2(roles.candidates(t), roles.questions(t), 0.05)
    return out.select(*KEYS, F.size("cards").cast("long").alias("n_cards"), F.array_join(F.transform("cards", lambda c: c["card_id"].cast("string")), " ").alias("cards"))


@query(f"with {roles.RETRIEVED} select country, item_id, string_agg(card_id::varchar, ' ' order by rank) as cards from candidates group by all")
def collect_ranked_cards(t: Tables) -> DataFrame:
    out = retrieval.nest(roles.candidates(t), KEYS, ["card_id", "rerank"])
    return out.select(*KEYS, F.array_join(F.transform("cards", lambda c: c["card_id"].cast("string")), " ").alias("cards"))


@query(f"with {roles.RETRIEVED}, n as (select q.country, q.item_id, count(c.card_id) as k from questions q left join candidates c on q.country = c.country and q.item_id = c.item_id and rank <= 3 and rerank >= 0.05 group by all) select country, count(*) filter (where k = 0)::bigint as n0, count(*) filter (where k = 1)::bigint as n1, count(*) filter (where k = 2)::bigint as n2, count(*) filter (where k = 3)::bigint as n3 from n group by country")
def cards_histogram(t: Tables) -> DataFrame:
    n = F.size("cards")
    out = retrieval.v2(roles.candidates(t), roles.questions(t), 0.05)
    return out.groupBy("country").agg(*[F.count_if(n == k).alias(f"n{k}") for k in range(4)])


@query(f"with {roles.RETRIEVED}, n as (select q.country, q.item_id, count(c.card_id) as k from questions q left join candidates c on q.country = c.country and q.item_id = c.item_id and rank <= 3 and rerank >= 0.05 group by all) select country, item_id, k > 0 as has_context from n")
def has_context(t: Tables) -> DataFrame:
    return retrieval.v2(roles.candidates(t), roles.questions(t), 0.05).select(*KEYS, (F.size("cards") > 0).alias("has_context"))


@query(f"""with {roles.RETRIEVED}, logits as (select country, item_id, card_id, case when country = 'src1' then rerank * 20 - 1 else rerank end as x from candidates),
b as (select *, min(x) over (partition by country) < 0 or max(x) over (partition by country) > 1 as l from logits)
select country, item_id, card_id, round(case when l then 1 / (1 + exp(-x)) else x end, 6) as score from b""")
def conditional_sigmoid(t: Tables) -> DataFrame:
    """Raw logits in one region only; the others' scores are within 0..1 and stay."""
    x = F.when(F.col("country") == "src1", F.col("rerank") * 20 - 1).otherwise(F.col("rerank"))
    rows = roles.candidates(t).withColumn("x", x)
    return rows.select(*KEYS, "card_id", F.round(scores.sigmoid_if_logits(F.col("x"), "country"), 6).alias("score"))


@query(f"""with {roles.RETRIEVED}, n as (select country, item_id, list(rerank order by rerank desc) as s from candidates where rank <= 3 group by all)
select country, item_id, round(s[1] - coalesce(s[2], 0.0), 6) as gap from n""")
def score_gap(t: Tables) -> DataFrame:
    from ragloom.operators import gate

    s = roles.candidates(t).where("rank <= 3").groupBy(*KEYS).agg(F.collect_list("rerank").alias("s"))
    return s.select(*KEYS, F.round(gate.score_features(F.col("s"))["r_gap"], 6).alias("gap"))


@query(f"""with {roles.RETRIEVED}, n as (select country, item_id, list(rerank order by rerank desc) as s from candidates where rank <= 3 group by all)
select country, item_id, list_max(s) as r_max, round(list_sum(s) / len(s), 6) as r_mean, list_min(s) as r_min, len(s)::bigint as n_cards from n""")
def array_stats(t: Tables) -> DataFrame:
    from ragloom.operators import gate

    s = roles.candidates(t).where("rank <= 3").groupBy(*KEYS).agg(F.collect_list("rerank").alias("s"))
    f = gate.score_features(F.col("s"))
    return s.select(*KEYS, f["r_max"].alias("r_max"), F.round(f["r_mean"], 6).alias("r_mean"), f["r_min"].alias("r_min"), f["n_cards"].cast("long").alias("n_cards"))


@query(f"""with {roles.CARDS}, {roles.QUESTIONS}, w as (select card_id, country, [card_id % 7, card_id % 11] as written_for from cards)
select q.country, q.item_id, count(*)::bigint as n from questions q join w using (country) where not list_contains(written_for, item_id) group by all""")
def leave_own_out(t: Tables) -> DataFrame:
    """Cards that were not written for the question."""
    c = roles.cards(t).select("card_id", "country", F.array(F.col("card_id") % 7, F.col("card_id") % 11).alias("written_for"))
    grid = roles.questions(t).join(c, "country")
    return retrieval.leave_own_out(grid, "written_for", "item_id").groupBy(*KEYS).agg(F.count("*").alias("n"))


@query(f"with {roles.CARDS}, {roles.GOLDS}, {roles.HITS}, a as (select country, item_id, count(*) as n from hits group by all) select item_id, count(*)::bigint as regions, bool_and(n >= 2) as always from a group by item_id")
def bool_quantifiers(t: Tables) -> DataFrame:
    n = roles.gold_hits(t).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return n.groupBy("item_id").agg(F.count("*").alias("regions"), F.bool_and(F.col("n") >= 2).alias("always"))


EMBED = """w as (select item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')) as w from benchmark),
h as (select item_id, ('0x' || substr(md5(w), 1, 8))::bigint as h from w),
c as (select item_id, h % 16 as d, sum(case when h & 32768 <> 0 then 1.0 else -1.0 end)::double as x from h group by all),
n as (select item_id, sqrt(sum(x * x)) as norm from c group by all),
g as (select item_id, i as d from benchmark cross join range(0, 16) r(i))"""


@query(f"with {EMBED} select item_id, list(coalesce(round(x / nullif(norm, 0), 6), 0.0) order by d) as vector from g left join c using (item_id, d) left join n using (item_id) group by item_id")
def embed_standin(t: Tables) -> DataFrame:
    """The embedding stage with its stand-in model: one call per distinct text."""
    out = models.call_distinct(t.benchmark, "text", "vector", models.hashed_embedder(), "array<double>")
    return out.select("item_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"with {roles.CARDS} select card_id, {roles.norm('text_en')} as normal from cards")
def distinct_then_join(t: Tables) -> DataFrame:
    """A costly function once per distinct text, joined back."""
    once = t.documents.select("text").distinct().withColumn("normal", text.normalize(F.col("text")))
    return t.documents.join(once, "text").select(F.col("doc_id").alias("card_id"), "normal")
