"""How the driver's tables stand in for questions, cards, vectors, jobs, answers and outcomes; each as a DataFrame and as
a DuckDB common table expression."""

from __future__ import annotations

from itertools import count
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import models, scores, text
from ragloom.operators import blocked, retrieval

from .registry import Tables

DEV = ("src0", "src1", "src2")
PROMPTS = ("p0", "p1")
MODELS = ("m0", "m1", "m2")


def cards(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id as card_id", "source as country", "lang as language", "text as text_en", "n_chars", "concat('c', doc_id % 6) as category")


def questions(t: Tables) -> DataFrame:
    """Every benchmark item is asked in every region. Regions are configuration: some rows."""
    regions = t.documents.select(F.col("source").alias("country")).distinct()
    items = t.benchmark.selectExpr("item_id", "text as question", "concat('t', item_id % 6) as topic")
    return items.crossJoin(F.broadcast(regions))


def golds(t: Tables) -> DataFrame:
    """An item's gold answers: its distinct phrases of two words of six letters or more each."""
    long = F.filter(text.phrases(F.col("text"), 2), lambda p: F.forall(F.split(p, " "), lambda w: F.length(w) >= 6))
    return t.benchmark.select("item_id", F.explode(F.array_distinct(long)).alias("gold"))


def gold_hits(t: Tables) -> DataFrame:
    """(country, item_id, card_id, gold=true) of cards that mention a gold as whole words."""
    return retrieval.mentions(cards(t), golds(t), ["country", "card_id"], "text_en", [2]).select("country", "item_id", "card_id").distinct().withColumn("gold", F.lit(True))


def with_texts(t: Tables, top: DataFrame, most: int, made: str, of) -> DataFrame:
    """`top` (country, item_id, card_id, ..), `most` rows a question at most, with `made`, which `of` makes of a card's text. Only the texts
    of these cards are taken apart, each once."""
    names = [c for c in top.columns if c not in ("country", "card_id")]
    few = top.groupBy("country", "card_id").agg(F.collect_list(F.struct(*names)).alias("__top"))
    few = retrieval.small(few, of=questions(t).select("country", "item_id"), more=most * 128)
    held = retrieval.dealt(cards(t).select("country", "card_id", "text_en").join(few, ["country", "card_id"]), "country", "card_id")
    pairs = held.select("country", "card_id", of(F.col("text_en")).alias(made), "__top")
    return pairs.select("country", "card_id", made, F.explode("__top").alias("__top")).select("country", "card_id", made, *[F.col(f"__top.{c}").alias(c) for c in names])


def with_gold(t: Tables, top: DataFrame, most: int) -> DataFrame:
    """`top` as for `with_texts`, with `gold`: whether the card mentions a gold of the item as whole words."""
    own = golds(t).groupBy("item_id").agg(F.collect_list("gold").alias("golds"))
    pairs = with_texts(t, top, most, "phrases", lambda x: text.phrases(x, 2)).join(own, "item_id", "left")
    return pairs.withColumn("gold", F.coalesce(F.arrays_overlap("phrases", "golds"), F.lit(False))).drop("phrases", "golds")


def vectors(t: Tables, asked: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`asked` (country, item_id) and `held` (country, card_id, text_en) with their vectors. `embeddings` has the vec_ids 0 to its row count
    less one; items and cards are dealt over all of them."""
    n = max(1, t.embeddings.count())
    step = next(s for s in count(7) if gcd(s, n) == 1)  # a step that shares a factor with n would pass vectors by
    known = t.embeddings.select("vec_id", "embedding")
    q = asked.select("country", "item_id", (F.col("item_id") % n).alias("vec_id")).join(known, "vec_id").drop("vec_id")
    c = held.withColumn("vec_id", (F.col("card_id") * step + 3) % n).join(known, "vec_id").drop("vec_id")
    return q, c


class Sides:
    """Questions and cards with vectors and terms (of some regions only), as blocks take them. Texts are taken apart in the blocks."""

    def __init__(self, t: Tables, regions: tuple[str, ...] = (), vector: bool = True):
        own = lambda df: df.where(F.col("country").isin(*regions)) if regions else df
        self.asked, self.cards = own(questions(t)), own(cards(t))
        held = self.cards.select("country", "card_id", "text_en").where("country is not null")
        both = vectors(t, self.asked, held) if vector else (self.asked.select("country", "item_id"), held)
        self.q, self.c = blocked.with_terms(held, self.asked, of=both)
        self.rules = {"vector": "embedding" if vector else None, "of": (self.asked, self.cards)}

    def scored(self, k: int, fused: bool = False) -> DataFrame:
        return blocked.scored(self.q, self.c, k, fused=fused, **self.rules)

    def grid(self) -> DataFrame:
        return blocked.grid(self.q, self.c, **self.rules)


def dense_scores(t: Tables) -> DataFrame:
    """Cosines of question and card vectors by an equi-join on the region."""
    q, c = vectors(t, questions(t), cards(t))
    return retrieval.dense(q, c, "country", "item_id", "card_id", "embedding", "embedding")


def bm25_scores(t: Tables) -> DataFrame:
    return Sides(t, vector=False).grid().select("country", "item_id", "card_id", "bm25")


def cross_scores(t: Tables) -> DataFrame:
    return Sides(t).grid()


def extremes(t: Tables) -> DataFrame:
    return blocked.extremes(Sides(t).scored(0))


def graded(t: Tables) -> DataFrame:
    """The whole grid with dense, bm25 and their min-max forms. Blocks are scored twice, first for the extremes alone, so that no pair is shuffled."""
    sides, keys = Sides(t), ["country", "item_id"]
    ends = retrieval.small(blocked.extremes(sides.scored(0)), of=sides.asked.select(*keys), more=64)
    return blocked.forms(sides.grid().join(ends, keys))


def survivors(t: Tables, k: int, regions: tuple[str, ...] = ()) -> DataFrame:
    """What of the grid (of some regions only) can be among a question's best k at any fusion weight, with the min-max forms over all
    cards of the region."""
    return blocked.graded(Sides(t, regions).scored(k, fused=True))


def ranked(t: Tables, k: int) -> DataFrame:
    """Cards that can be among a question's best k by ranks, with their ranks rd and rl among all cards."""
    sides = Sides(t)
    return blocked.ranked(sides.q, sides.c, blocked.narrowed(sides.scored(k), k), **sides.rules)


def candidates(t: Tables, alpha: float = 0.5, k: int = 20, regions: tuple[str, ...] = ()) -> DataFrame:
    """Top k by fusion with the stand-in reranker's scores and ranks."""
    group = ["country", "item_id"]
    top = retrieval.top_k(retrieval.hybrid(survivors(t, k, regions), alpha), k, group, "hybrid", out="place").select(*group, "card_id", "hybrid", "place")
    asked = t.benchmark.select("item_id", text.content_words(F.col("text")).alias("qw"))
    pairs = with_texts(t, top, k, "cw", text.content_words).join(asked, "item_id")
    scored = pairs.withColumn("rerank", F.round(models.lexical_reranker(F.col("qw"), F.col("cw")), 6)).drop("qw", "cw")
    return scored.withColumn("rank", scores.rank_within(group, F.col("rerank").desc(), F.col("card_id").asc()))


def outcomes(t: Tables) -> DataFrame:
    """Per question, model, prompt and region: both systems' scores, null where unscored, and a gate's probability."""
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.selectExpr(
        "doc_id", "concat('m', (doc_id div 40) % 3) as model", "source as country", "if(lang = 'en', 'English', 'Local') as language",
        "if((doc_id div 20) % 2 = 0, 'p0', 'p1') as prompt_no", "doc_id div 40 as qid", "concat('t', (doc_id div 40) % 6) as topic",
        "cast(quality as int) as score_b", "cast(1 - toxic as int) as score_v", "((doc_id * 37) % 101) / 100.0D as p", "text as response",
    )


def jobs(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").selectExpr("concat_ws('|', conv_id, turn) as job_id", "conv_id", "turn", "text as prompt", "conv_id % 3 = 0 as has_cards")


def answers(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").selectExpr("concat_ws('|', conv_id, turn - 1) as job_id", "conv_id", "text as response")


# The same in DuckDB.
def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def norm(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def idx(x: str) -> str:
    return f"list_filter({tok(x)}, lambda w: w not in {_in(text.INDEX_STOP_WORDS)})"


def content(x: str) -> str:
    return f"list_distinct(list_filter({tok(x)}, lambda w: length(w) > 2 and w not in {_in(text.CONTENT_STOP_WORDS)}))"


def share(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then len(list_intersect({a}, {b}))::double / len({a}) else 0.0 end)"


CARDS = "cards as (select doc_id as card_id, source as country, lang as language, text as text_en, n_chars, 'c' || (doc_id % 6) as category from documents)"
QUESTIONS = (
    "questions as (select country, item_id, text as question, 't' || (item_id % 6) as topic from benchmark cross join (select distinct source as country from documents))"
)
def pairs(x: str) -> str:
    """Phrases of two consecutive tokens of the list `x`."""
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"


GOLDS = f"""golds as (select distinct item_id, gold from (select item_id, unnest({pairs('w')}) as gold from (select item_id, {tok('text')} as w from benchmark))
    where length(split_part(gold, ' ', 1)) >= 6 and length(split_part(gold, ' ', 2)) >= 6)"""
HITS = (
    f"hits as (select distinct w.country, g.item_id, w.card_id, true as gold from (select country, card_id, unnest(list_distinct({pairs('w')})) as gold from (select country, card_id, {tok('text_en')} as w from cards)) w"
    " join golds g using (gold))"
)
DENSE = """unit as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u from embeddings),
dims as (select n, (select min(s) from range(7, 200) r(s) where gcd(s, n) = 1) as step from (select greatest(1, count(*)) as n from embeddings)),
qs as (select country, item_id, u as qu from questions cross join dims join unit on vec_id = item_id % n),
cs as (select country, card_id, u as cu from cards cross join dims join unit on vec_id = (card_id * step + 3) % n),
dense as (select country, item_id, card_id, round(list_inner_product(qu, cu), 6) as dense from qs join cs using (country))"""
BM25 = f"""ct as (select country, card_id, {idx('text_en')} as terms from cards),
lens as (select country, card_id, len(terms)::bigint as dl from ct),
tf as (select country, card_id, term, count(*) as tf from (select country, card_id, unnest(terms) as term from ct) group by all),
corp as (select country, count(*) as n, avg(dl) as avgdl from lens group by country),
raws as (select country, term, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select country, term, count(*) as df from tf group by all) join corp using (country)),
idf as (select country, term, case when raw < 0 then 0.25 * mean else raw end as idf from raws join (select country, avg(raw) as mean from raws group by country) using (country)),
asked as (select country, item_id, term, count(*) as times from (select country, item_id, unnest({idx('question')}) as term from questions) group by all),
found as (select country, item_id, card_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s
    from asked join tf using (country, term) join idf using (country, term) join lens using (country, card_id) join corp using (country) group by all),
bm25 as (select country, item_id, card_id, round(coalesce(s, 0.0), 6) as bm25 from questions join cards using (country) left join found using (country, item_id, card_id))"""
GRADED = """ranged as (select *, min(dense) over q as d0, max(dense) over q as d1, min(bm25) over q as l0, max(bm25) over q as l1
    from dense join bm25 using (country, item_id, card_id) window q as (partition by country, item_id)),
graded as (select country, item_id, card_id, dense, bm25, case when d1 > d0 then (dense - d0) / (d1 - d0) else 0.0 end as dn,
    case when l1 > l0 then (bm25 - l0) / (l1 - l0) else 0.0 end as ln from ranged)"""
GRID = ",\n".join([CARDS, QUESTIONS, DENSE, BM25, GRADED])
HYBRID = "fused as (select *, round(0.5 * dn + 0.5 * ln, 6) as hybrid from graded)"
TOP = "placed as (select *, row_number() over (partition by country, item_id order by hybrid desc, card_id) as place from fused)"
CANDIDATES = f"""words as (select p.country, p.item_id, p.card_id, hybrid, place, {content('b.text')} as qw, {content('c.text_en')} as cw
    from placed p join benchmark b using (item_id) join cards c using (card_id) where place <= 20),
cand as (select country, item_id, card_id, hybrid, place, round(case when len(list_distinct(list_concat(qw, cw))) > 0
    then len(list_intersect(qw, cw))::double / len(list_distinct(list_concat(qw, cw))) else 0.0 end, 6) as rerank from words),
candidates as (select *, row_number() over (partition by country, item_id order by rerank desc, card_id) as rank from cand)"""
RETRIEVED = ",\n".join([GRID, HYBRID, TOP, CANDIDATES])
OUTCOMES = """outcomes as (select d.doc_id, 'm' || ((d.doc_id // 40) % 3) as model, source as country, case when lang = 'en' then 'English' else 'Local' end as language,
    case when (d.doc_id // 20) % 2 = 0 then 'p0' else 'p1' end as prompt_no, d.doc_id // 40 as qid, 't' || ((d.doc_id // 40) % 6) as topic,
    quality::int as score_b, (1 - toxic)::int as score_v, ((d.doc_id * 37) % 101) / 100.0::double as p, text as response from documents d left join labels l on d.doc_id = l.doc_id)"""
JOBS = "jobs as (select conv_id || '|' || turn as job_id, conv_id, turn, text as prompt, conv_id % 3 = 0 as has_cards from conversations where role = 'user')"
ANSWERS = "answers as (select conv_id || '|' || (turn - 1) as job_id, conv_id, text as response from conversations where role = 'assistant')"
