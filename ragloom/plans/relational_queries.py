"""Sources, sinks, projections, filters, joins and text functions over the role views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import models, scores, text
from ragloom.operators import jobs, scoring
from ragloom.sources import readers, sinks

from . import roles
from .registry import Tables, query
from .roles import ANSWERS, CARDS, JOBS, OUTCOMES, QUESTIONS, content, norm, tok

OUT = f"with {OUTCOMES} "
JOB = f"with {JOBS}, {ANSWERS} "


# Sources and sinks
@query("select doc_id as card_id, source as country, lang as language, n_chars from documents")
def src_documents_project(t: Tables) -> DataFrame:
    return roles.cards(t).select("card_id", "country", "language", "n_chars")


@query("select source, lang, doc_id, n_chars from (select *, row_number() over (partition by source, lang order by doc_id) as n from documents) where n = 1")
def first_match_lookup(t: Tables) -> DataFrame:
    return readers.first_match(t.documents.select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], F.col("doc_id"))


@query("select source, lang, max(doc_id) as doc_id, max_by(n_chars, doc_id) as n_chars from documents group by all")
def last_wins_dedupe(t: Tables) -> DataFrame:
    return readers.last_match(t.documents.select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


@query("select event_id, unnest(json_keys(props)) as key, (props ->> ('$.' || unnest(json_keys(props))))::bigint as value from events")
def json_map_explode(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string, bigint>")).alias("key", "value"))


@query("select event_id, coalesce((props ->> '$.k')::bigint, -1) as k, coalesce((props ->> '$.absent')::bigint, 0) as absent from events")
def json_props_extract(t: Tables) -> DataFrame:
    get = lambda p: F.get_json_object("props", p).cast("long")
    return t.events.select("event_id", F.coalesce(get("$.k"), F.lit(-1)).alias("k"), F.coalesce(get("$.absent"), F.lit(0)).alias("absent"))


@query("select doc_id, source, null as kb_version from documents where lang is distinct from 'es' union all select doc_id, source, 'v2' from documents where lang = 'es'")
def union_optional_kb(t: Tables) -> DataFrame:
    first = t.documents.where("not (lang <=> 'es')").select("doc_id", "source")
    second = t.documents.where("lang = 'es'").select("doc_id", "source", F.lit("v2").alias("kb_version"))
    return readers.with_optional(first, second)


@query("select n_nationkey, 'nation' as run from nation")
def file_metadata_partition(t: Tables) -> DataFrame:
    """The file name as a partition value."""
    names = t.spark.read.parquet(f"{t.dir}/nation.parquet").select("n_nationkey", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1).alias("run"))
    return names


KINDS = [("c0", "web"), ("c1", "press"), ("c2", "web"), ("c3", "official"), ("c4", "press"), ("c5", "web")]
KIND_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in KINDS) + ") as k(category, kind)"


@query(f"with {CARDS} select card_id, category, kind, {tok('text_en')}[1] as topic from cards join {KIND_SQL} using (category)")
def inline_values_dim_join(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame(KINDS, "category string, kind string")
    first = F.try_element_at(text.tokens(F.col("text_en")), F.lit(1))
    return roles.cards(t).join(F.broadcast(dim), "category").select("card_id", "category", "kind", first.alias("topic"))


@query("select distinct country, unnest(case when l = 'English' then ['English'] else [l, 'English'] end) as language from (select source as country, case when min(doc_id) % 4 = 0 then 'English' else 'L' || (min(doc_id) % 4) end as l from documents group by source)")
def setting_enumeration(t: Tables) -> DataFrame:
    first = t.documents.groupBy(F.col("source").alias("country")).agg(F.min("doc_id").alias("d"))
    local = F.when(F.col("d") % 4 == 0, "English").otherwise(F.concat(F.lit("L"), (F.col("d") % 4).cast("string")))
    return readers.settings(first.withColumn("local_language", local))


@query("select doc_id, '{\"source\":\"' || source || '\",\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' as record from documents")
def to_json_record(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sinks.json_record("source", "lang", "n_chars").alias("record"))


@query(JOB + "select has_cards, count(*)::bigint as n from jobs group by all")
def side_output_split(t: Tables) -> DataFrame:
    every, carded = jobs.side_output(roles.jobs(t), F.col("has_cards"))
    rest = every.where(~F.col("has_cards"))
    return carded.groupBy("has_cards").agg(F.count("*").alias("n")).union(rest.groupBy("has_cards").agg(F.count("*").alias("n")))


@query(JOB + "select job_id from jobs where job_id not in (select job_id from answers)")
def resume_anti_join(t: Tables) -> DataFrame:
    return jobs.unfinished(roles.jobs(t), roles.answers(t)).select("job_id")


@query(OUT + "select distinct model, country, prompt_no from outcomes where (model, country, prompt_no) not in (select (model, country, prompt_no) from outcomes where score_b is not null)")
def pending_groups(t: Tables) -> DataFrame:
    o = roles.outcomes(t)
    keys = ["model", "country", "prompt_no"]
    return sinks.pending(o.select(*keys).distinct(), o.where("score_b is not null"), keys)


# Projections and filters
@query(f"with {CARDS} select card_id, case when language = 'en' then text_en else country end as shown from cards")
def conditional_projection(t: Tables) -> DataFrame:
    shown = jobs.question_text(F.col("language"), F.lit("en"), F.col("text_en"), F.col("country"))
    return roles.cards(t).select("card_id", shown.alias("shown"))


@query("select doc_id, source || '/' || lang as inner_key, n_chars as inner_n from documents")
def nested_struct_build(t: Tables) -> DataFrame:
    nested = t.documents.select("doc_id", F.struct(F.concat_ws("/", "source", "lang").alias("key"), F.col("n_chars").alias("n")).alias("s"))
    return nested.select("doc_id", F.col("s.key").alias("inner_key"), F.col("s.n").alias("inner_n"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def filter_eq(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("select doc_id, lang from documents where lang in ('en', 'es')")
def filter_in(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang").isin("en", "es")).select("doc_id", "lang")


@query("select qid, country from (select doc_id // 40 as qid, source as country, doc_id % 4 as na, doc_id % 3 as nap, doc_id % 7 as idk, doc_id % 5 as n from documents) where not (na + nap >= 3 or idk >= 5 or n = 0)")
def scorable_predicate(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    keep = scoring.scorable(d % 4, d % 3, d % 7, F.size(F.slice(F.array(*[F.lit(i) for i in range(5)]), 1, (d % 5).cast("int"))))
    return t.documents.where(keep).selectExpr("doc_id div 40 as qid", "source as country")


@query(OUT + "select doc_id, score_b from outcomes where score_b is not null")
def filter_not_null(t: Tables) -> DataFrame:
    return roles.outcomes(t).where(F.col("score_b").isNotNull()).select("doc_id", "score_b")


@query(f"select item_id, list_sort(list_distinct(list_filter({tok('text')}, lambda w: length(w) >= 3))) as words from benchmark")
def array_filter_len(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_sort(F.array_distinct(F.filter(text.tokens(F.col("text")), lambda w: F.length(w) >= 3))).alias("words"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join_keys(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query(OUT + "select doc_id from outcomes where not (topic in ('t0', 't1')) and country <> 'src3' and score_b is not null")
def mask_algebra(t: Tables) -> DataFrame:
    o = roles.outcomes(t)
    in_test, labelled = F.col("topic").isin("t0", "t1"), F.col("score_b").isNotNull()
    return o.where(~in_test & (F.col("country") != "src3") & labelled).select("doc_id")


# Joins
@query("select b.doc_id, b.quality as value_b, v.toxic as value_v from labels b join labels v using (doc_id)")
def inner_join_suffix(t: Tables) -> DataFrame:
    base = t.labels.select("doc_id", F.col("quality").alias("value_b"))
    other = t.labels.select("doc_id", F.col("toxic").alias("value_v"))
    return base.join(other, "doc_id")


@query("select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 45")
def enrich_join(t: Tables) -> DataFrame:
    heavy = t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return heavy.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query(OUT + "select doc_id, coalesce(case when country = 'src1' then score_v end, score_b) as score from outcomes")
def left_join_coalesce(t: Tables) -> DataFrame:
    o = roles.outcomes(t)
    overlay = o.where("country = 'src1'").select("doc_id", F.col("score_v").alias("s"))
    return o.join(overlay, "doc_id", "left").select("doc_id", F.coalesce("s", "score_b").alias("score"))


@query(JOB + "select a.job_id, length(j.prompt)::bigint as prompt_len from answers a join jobs j using (job_id)")
def strict_lookup_join(t: Tables) -> DataFrame:
    joined = jobs.strict(roles.answers(t).select("job_id"), roles.jobs(t).select("job_id", "prompt"), ["job_id"])
    return joined.select("job_id", F.length("prompt").cast("long").alias("prompt_len"))


@query(JOB + "select job_id, coalesce(response, '') as response from jobs left join answers using (job_id)")
def lookup_default(t: Tables) -> DataFrame:
    return jobs.lenient(roles.jobs(t).select("job_id"), roles.answers(t).select("job_id", "response"), ["job_id"], {"response": ""})


@query(OUT + "select doc_id from outcomes where (country, qid) in (select (country, qid) from outcomes where score_v = 1)")
def semi_join_tuple(t: Tables) -> DataFrame:
    o = roles.outcomes(t)
    return o.join(o.where("score_v = 1").select("country", "qid"), ["country", "qid"], "left_semi").select("doc_id")


MERGED = JOB + ", m as (select j.job_id, case when j.has_cards then 'R: ' || a.response else a.response end as response, case when j.has_cards then 'rag' else 'baseline' end as source from jobs j left join answers a using (job_id)) "


def _merged(t: Tables) -> DataFrame:
    j, a = roles.jobs(t), roles.answers(t)
    rag = a.select("job_id", F.concat(F.lit("R: "), F.col("response")).alias("response"))
    return jobs.gated_merge(j.select("job_id"), j.where("has_cards"), rag, a)


@query(MERGED + "select job_id, length(response)::bigint as n, source from m where response is not null")
def gated_merge(t: Tables) -> DataFrame:
    return _merged(t).where("response is not null").select("job_id", F.length("response").cast("long").alias("n"), "source")


@query(MERGED + "select job_id, source from m where response is null")
def gated_merge_missing(t: Tables) -> DataFrame:
    return jobs.missing(_merged(t)).select("job_id", "source")


@query(MERGED + "select source, count(*)::bigint as n, count(response)::bigint as answered from m group by source")
def route_counts(t: Tables) -> DataFrame:
    return _merged(t).groupBy("source").agg(F.count("*").alias("n"), F.count("response").alias("answered"))


@query(f"with {QUESTIONS} select country || '|' || language || '|' || prompt_no || '|' || item_id as job_id from questions cross join (values ('English'), ('Local')) as l(language) cross join (values ('p0'), ('p1')) as p(prompt_no)")
def job_enumeration(t: Tables) -> DataFrame:
    q = roles.questions(t).withColumnRenamed("item_id", "qid")
    settings = q.select("country").distinct().withColumn("language", F.explode(F.array(F.lit("English"), F.lit("Local"))))
    prompts = t.spark.createDataFrame([(p,) for p in roles.PROMPTS], "prompt_no string")
    return jobs.enumerate_jobs(settings, prompts, q).select("job_id")


@query("select source, bool_and(quality = 1) as every, count(*)::bigint as n from documents join labels using (doc_id) group by source having bool_or(quality = 1)")
def division_all_regions(t: Tables) -> DataFrame:
    """For-all over groups: which sources have good documents only."""
    rows = t.documents.join(t.labels, "doc_id").withColumn("ok", F.col("quality") == 1)
    return rows.groupBy("source").agg(F.bool_and("ok").alias("every"), F.count("*").alias("n"), F.bool_or("ok").alias("any")).where("any").drop("any")


@query("""with has as (select source, count(distinct lang)::bigint as has from documents join labels using (doc_id) where quality = 1 group by source),
w as (select count(distinct lang)::bigint as wanted from documents) select source, has, wanted, has = wanted as every from has cross join w where has > 0""")
def division_all_members(t: Tables) -> DataFrame:
    """Relational division: which sources have a good document in every language that there is."""
    rows = t.documents.join(t.labels, "doc_id")
    return jobs.divide(rows, "source", "lang", F.col("quality") == 1, t.documents)


@query(OUT + f", n as (select model, country, qid, min(case when prompt_no = 'p0' then {norm('response')} end) as a, min(case when prompt_no = 'p1' then {norm('response')} end) as b from outcomes group by all) select model, country, qid, coalesce((a = b)::int, 0) as agree from n")
def self_consistency(t: Tables) -> DataFrame:
    from ragloom.operators import gate

    return gate.agreement(roles.outcomes(t), ["model", "country", "qid"], "prompt_no", "p0", "p1")


@query("select page_id, ref from (select page_id, unnest([page_id * 3, page_id * 5]) as ref from pages) where ref not in (select doc_id from documents)")
def ref_integrity_violations(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id")
    return jobs.integrity(rows, F.array(F.col("page_id") * 3, F.col("page_id") * 5), t.documents.select(F.col("doc_id").alias("ref")), "ref")


# Text functions
@query(f"select doc_id, len(w)::bigint as n, coalesce(w[1], '') as first, coalesce(w[len(w)], '') as last from (select doc_id, {tok('text')} as w from documents)")
def tokenize_unicode(t: Tables) -> DataFrame:
    w = text.tokens(F.col("text"))
    at = lambda i: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(""))
    return t.documents.select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query(f"select item_id, list_sort({content('text')}) as words from benchmark")
def content_words(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_sort(text.content_words(F.col("text"))).alias("words"))


@query(f"select item_id, {norm('text')} as normal from benchmark")
def normalize_text(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.normalize(F.col("text")).alias("normal"))


@query(f"select doc_id, len({roles.idx('text')})::bigint as kept, len({tok('text')})::bigint as n from documents")
def stopword_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.index_tokens(F.col("text"))).cast("long").alias("kept"), F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query(JOB + f", w as (select job_id, {content('response')} as a, {content('prompt')} as b from jobs join answers using (job_id)) select job_id, round({roles.share('a', 'b')}, 6) as share from w")
def word_overlap_share(t: Tables) -> DataFrame:
    pairs = roles.jobs(t).join(roles.answers(t).select("job_id", "response"), "job_id")
    return pairs.select("job_id", F.round(text.overlap_share(text.content_words(F.col("response")), text.content_words(F.col("prompt"))), 6).alias("share"))


@query("select item_id, replace('Q: {q}? A:', '{q}', text) as prompt from benchmark")
def template_fill(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.fill(F.lit("Q: {q}? A:"), "q", F.col("text")).alias("prompt"))


@query("with c as (select conv_id, list(text order by turn) as texts from conversations where role = 'assistant' group by conv_id) select conv_id, '" + text.HEADERS["v1"].replace("{place}", "' || 'Region' || '") + "' || chr(10) || array_to_string([ '[' || i || '] ' || texts[i] for i in range(1, len(texts) + 1) ], chr(10)) || chr(10) || chr(10) as block from c")
def context_block(t: Tables) -> DataFrame:
    c = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return c.select("conv_id", text.context_block(F.lit("Region"), F.col("s.text")).alias("block"))


_J = "'" + text.JUDGE.replace("'", "''") + "'"


@query(f"select item_id, replace(replace(replace({_J}, '{{notes}}', '- ' || text), '{{question}}', 'Q' || item_id), '{{country}}', 'src 1') as prompt from benchmark")
def judge_prompt(t: Tables) -> DataFrame:
    q = F.concat(F.lit("Q"), F.col("item_id").cast("string"))
    return t.benchmark.select("item_id", text.judge_prompt(F.lit("src_1"), q, F.array("text")).alias("prompt"))


@query("select doc_id, length(text || ' ' || array_to_string(case when doc_id % 3 = 0 then [] else [lang, source] end, ' '))::bigint as n from documents")
def index_text(t: Tables) -> DataFrame:
    words = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.array("lang", "source"))
    return t.documents.select("doc_id", F.length(text.index_text(F.col("text"), words)).cast("long").alias("n"))


@query("select source || '|' || lang || '|' || doc_id as key from documents")
def composite_key(t: Tables) -> DataFrame:
    return t.documents.select(text.composite_key(F.col("source"), F.col("lang"), F.col("doc_id")).alias("key"))


@query("select doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))::bigint as n from documents")
def word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.word_count(F.col("text")).cast("long").alias("n"))


LPS = "[{'token': case when doc_id % 2 = 0 then ' Yes' else 'NO' end, 'lp': -0.1 * (doc_id % 7)}, {'token': 'no', 'lp': -0.2 * (doc_id % 5)}, {'token': 'maybe', 'lp': -1.0}]"


@query(f"with l as (select doc_id, {LPS} as a from labels), e as (select doc_id, list_sum(list_transform(list_filter(a, lambda x: upper(trim(x.token)) like 'YES%'), lambda x: exp(x.lp::double))) as y, list_sum(list_transform(list_filter(a, lambda x: upper(trim(x.token)) like 'NO%'), lambda x: exp(x.lp::double))) as n from l) select doc_id, round(coalesce(y, 0.0) / (coalesce(y, 0.0) + n), 6) as p from e")
def judge_p_yes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    pair = lambda token, lp: F.struct(token.alias("token"), lp.cast("double").alias("logprob"))
    a = F.array(pair(F.when(d % 2 == 0, " Yes").otherwise("NO"), -0.1 * (d % 7)), pair(F.lit("no"), -0.2 * (d % 5)), pair(F.lit("maybe"), F.lit(-1.0)))
    return t.labels.select("doc_id", F.round(scores.p_yes(a, F.lit("")), 6).alias("p"))


@query("select p_partkey, translate(p_type, '_', ' ') as shown, case p_brand when 'Brand#11' then 'Eleven' when 'Brand#12' then 'Twelve' else p_brand end as brand from part")
def display_name(t: Tables) -> DataFrame:
    names = F.create_map(F.lit("Brand#11"), F.lit("Eleven"), F.lit("Brand#12"), F.lit("Twelve"))
    return t.part.select("p_partkey", F.translate("p_type", "_", " ").alias("shown"), F.coalesce(names[F.col("p_brand")], F.col("p_brand")).alias("brand"))


@query(JOB + "select job_id, trim(regexp_replace(trim(regexp_replace(lower(trim('Answer: ' || response)), '^(answer|response)\\s*:\\s*', '')), '\\.+$', '')) as cleaned from answers")
def clean_response(t: Tables) -> DataFrame:
    return roles.answers(t).select("job_id", text.clean_response(F.concat(F.lit("Answer: "), F.col("response"))).alias("cleaned"))


@query("select source, doc_id, '[' || row_number() over (partition by source order by doc_id) || '] ' || lang as line, printf('V2_%04d', doc_id) as card from documents")
def enumerate_format(t: Tables) -> DataFrame:
    n = scoring.running_rank(["source"], F.col("doc_id")).cast("string")
    return t.documents.select("source", "doc_id", F.concat(F.lit("["), n, F.lit("] "), F.col("lang")).alias("line"), F.format_string("V2_%04d", F.col("doc_id")).alias("card"))


# Order, limit, sample, set operations
@query(JOB + "select job_id, conv_id, turn from jobs where job_id not in (select job_id from answers) order by conv_id, turn limit 10")
def limit_first_n(t: Tables) -> DataFrame:
    todo = jobs.unfinished(roles.jobs(t), roles.answers(t)).select("job_id", "conv_id", "turn")
    return scoring.first_by(todo, 10, F.col("conv_id"), F.col("turn"))


@query("select doc_id from documents order by md5('s0' || doc_id::varchar), doc_id limit 100")
def hash_sample_ids(t: Tables) -> DataFrame:
    """A seeded sample of 100 ids."""
    return scoring.hash_sample(t.documents.select("doc_id"), "doc_id", 100, "s0")


ORDER = ["es", "en", "fr"]


@query("select lang, count(*)::bigint as n, coalesce(list_position(['es', 'en', 'fr'], lang), 4)::bigint as position from documents group by lang")
def explicit_order(t: Tables) -> DataFrame:
    return scoring.order_by_list(scoring.value_counts(t.documents, "lang"), "lang", ORDER)


@query(OUT + "select run, country, count(*)::bigint as n from (select 'a' as run, country from outcomes where prompt_no = 'p0' union all select 'b', country from outcomes where prompt_no = 'p1') group by all")
def union_all_runs(t: Tables) -> DataFrame:
    o = roles.outcomes(t)
    a, b = (o.where(F.col("prompt_no") == p).select(F.lit(r).alias("run"), "country") for p, r in (("p0", "a"), ("p1", "b")))
    return a.unionByName(b).groupBy("run", "country").agg(F.count("*").alias("n"))


@query("select l_returnflag, count(*)::bigint as n from lineitem group by l_returnflag")
def value_counts(t: Tables) -> DataFrame:
    return scoring.value_counts(t.lineitem, "l_returnflag")


@query("select min(l_quantity) as min, quantile_cont(l_quantity, 0.5) as median, max(l_quantity) as max from lineitem")
def describe_min_med_max(t: Tables) -> DataFrame:
    return scoring.describe(t.lineitem, "l_quantity")


@query(f"with {JOBS} select job_id, array_to_string(w[greatest(1, len(w) - 4):], ' ') as response from (select job_id, regexp_extract_all(coalesce(prompt, ''), '[^\\x20\\x09-\\x0D]+') as w from jobs)")
def generate_standin(t: Tables) -> DataFrame:
    """The generation stage with its stand-in model."""
    return models.call(roles.jobs(t).select("job_id", "prompt"), "prompt", "response", models.echo_generator(), "string").select("job_id", "response")
