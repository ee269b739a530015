"""Retrieval within partitions: BM25, dense scores, fusion, top-k, cut-offs and diagnostics.

Scores are long rows (question, card, score) and never positions. A question only meets the cards of its own partition
(country), so every score comes from an equi-join on it. Scores are kept to `DIGITS` decimals, so that no rank depends on the
order in which a shuffle delivers the terms of a sum; ties go to the smaller card id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions import scores, text

DIGITS = 6
#: Bytes of the questions' side that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Parts of a key's cards for each of a shuffle's partitions: as many as that, since a hash that puts parts into partitions is uneven.
SALTS = 8
#: Cards of a part whose terms are counted together, on average.
COUNTED = 4096


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by `keys` before they fan out, so that a partition (country) with most of the rows is no single task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def row_bytes(df: DataFrame) -> Column:
    """At least the bytes of a row's values, and 32 for the row itself."""

    def width(f: T.StructField) -> Column:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return 16 + F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            return 16 + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return 16 + 8 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(16)

    return sum(map(width, df.schema.fields), F.lit(32)).cast("long")


def fits(df: DataFrame, limit: int = BROADCAST_BYTES, more: int = 0) -> bool:
    """Whether all rows, with `more` bytes each, are measured at `limit` bytes or less."""
    return (df.agg(F.sum(row_bytes(df) + more)).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES, of: DataFrame | None = None, more: int = 0) -> DataFrame:
    """`df` with a broadcast hint if it is measured to fit; as it is beyond that. `of` is a plainer table with as many rows or more, whose
    rows have at most `more` bytes less: it is measured in the place of `df`."""
    return F.broadcast(df) if fits(df if of is None else of, limit, more) else df


def meet(held: DataFrame, asked: DataFrame, keys: list[str], card: str, limit: int = BROADCAST_BYTES, of: DataFrame | None = None, more: int = 0) -> DataFrame:
    """Join of cards' rows and questions' rows on `keys`. Questions are broadcast if they are measured to fit. Beyond that a key's cards are
    dealt over `SALTS` parts for each of a shuffle's partitions, and its questions go to each: the output is their product anyhow, so
    copies of one side cost little beside it, and no key is one task."""
    if fits(asked if of is None else of, limit, more):
        return held.join(F.broadcast(asked), keys)
    parts = SALTS * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = held.withColumn("__part", F.pmod(F.xxhash64(card), F.lit(parts)).cast("int"))
    right = asked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*keys, "__part"]).drop("__part")


def term_statistics(cards: DataFrame, part: str = "country", card: str = "card_id", body: str = "text_en") -> DataFrame:
    """(part, card, dl, term, tf), with the term '' once for every card. Cards are unique within their part. A text moves once and
    as a whole; its terms are counted where it lies."""
    split = dealt(cards.select(part, card, body), part, card).select(part, card, text.index_tokens(F.col(body)).alias("terms"))
    rows = split.select(part, card, F.size("terms").cast("long").alias("dl"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    return rows.groupBy(part, card, "dl", "term").agg(F.count("*").alias("tf"))


def lengths(tf: DataFrame, part: str) -> DataFrame:
    """Number of cards and their average length by part; every card has one row of the term ''."""
    return tf.where("term = ''").groupBy(part).agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def asked_by_row(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, term): every index token of a text in a row, taken apart as the cards' are (`text.split_terms`)."""
    given = df.select(*keys, F.lower(F.coalesce(F.col(body), F.lit(""))).alias("term"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words, own = text.split_terms(b.column(len(keys)))
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(own)) for i in range(len(keys))], words], [*keys, "term"])

    return given.mapInArrow(run, given.schema)


def term_counts(cards: DataFrame, part: str = "country", body: str = "text_en", card: str = "card_id", block: int = COUNTED) -> DataFrame:
    """(part, term, n): how many cards of a part have a term, for all terms. A card also counts under its number of tokens behind a blank,
    which no token has, so that a text is taken apart once for frequencies and lengths. Cards of a part are dealt into blocks of about
    `block` rows, whose terms are counted before anything is sent on: a term is one row a block and not one a card."""
    rows = cards.where(F.col(part).isNotNull()).select(part, card, F.lower(F.coalesce(F.col(body), F.lit(""))).alias("term"))
    sizes = small(cards.where(F.col(part).isNotNull()).groupBy(part).agg(F.ceil(F.count("*") / block).alias("__n")))
    rows = rows.join(sizes, part).withColumn("__block", F.pmod(F.xxhash64(card), F.col("__n")))
    # no nulls, so that no reader adds a filter of its own: all share one exchange, and texts are read once
    out = T.StructType([T.StructField(part, cards.schema[part].dataType, False), T.StructField("term", T.StringType(), False), T.StructField("n", T.LongType(), False)])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            parts, (words, own) = b.column(0).dictionary_encode(), text.split_terms(b.column(1))
            of = parts.indices.to_numpy().astype("int64")
            terms, lengths = words.dictionary_encode(), np.bincount(own, minlength=len(b))
            held = np.sort(own * len(terms.dictionary) + terms.indices.to_numpy())
            held = held[np.flatnonzero(np.diff(held, prepend=-1))]  # a card's term once
            card, term = np.divmod(held, max(1, len(terms.dictionary)))
            for kinds, keys, every in ((terms.dictionary, of[card], term), (None, of, lengths)):
                span = int(every.max(initial=0)) + 1
                found, n = np.unique(keys * span + every, return_counts=True)
                at, kind = np.divmod(found, span)
                names = kinds.take(pa.array(kind)) if kinds is not None else pc.binary_join_element_wise("", pa.array(kind).cast("string"), " ")
                yield pa.RecordBatch.from_arrays([parts.dictionary.take(pa.array(at)), names, pa.array(n.astype("int64"))], out.names)

    counted = dealt(rows, part, "__block").select(part, "term").mapInArrow(run, out)
    return counted.groupBy(part, "term").agg(F.sum("n").alias("n"))


def corpora(counts: DataFrame, part: str = "country") -> DataFrame:
    """(part, n_cards, avgdl, mean) from `term_counts`: cards, their average length and the mean idf of the distinct terms. Terms are summed
    up by frequency, so that the counts are read once for all of these."""
    length = F.when(F.startswith("term", F.lit(" ")), F.col("term").substr(2, 20).cast("long"))
    few = counts.groupBy(part, length.alias("length"), "n").agg(F.count("*").alias("terms"))
    card, term = F.col("length").isNotNull(), F.col("length").isNull()
    made = few.groupBy(part).agg(
        F.sum(F.when(card, F.col("n"))).alias("n_cards"), F.sum(F.col("length") * F.col("n")).alias("tokens"), F.array_sort(F.collect_list(F.when(term, F.struct("n", "terms")))).alias("by_df"),
    )
    total = F.aggregate("by_df", F.lit(0.0), lambda s, x: s + x["terms"] * raw_idf(F.col("n_cards"), x["n"]))
    terms = F.aggregate("by_df", F.lit(0).cast("long"), lambda s, x: s + x["terms"])
    return made.select(part, "n_cards", (F.col("tokens") / F.col("n_cards")).alias("avgdl"), F.when(F.size("by_df") > 0, total / terms).alias("mean"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def asked_terms(questions: DataFrame, part: str, question: str, ask: str) -> DataFrame:
    return questions.select(part, question, F.explode(text.index_tokens(F.col(ask))).alias("term")).groupBy(part, question, "term").agg(F.count("*").alias("times"))


def counted_weights(counts: DataFrame, questions: DataFrame, part: str, question: str, ask: str, floor: float) -> DataFrame:
    """As `term_weights`, from `term_counts`."""
    stats = small(corpora(counts, part), of=questions.select(part).distinct(), more=64)
    asked = asked_by_row(questions, [part, question], ask).groupBy(part, question, "term").agg(F.count("*").alias("times"))
    met = asked.join(counts, [part, "term"]).join(stats, part).withColumn("raw", raw_idf(F.col("n_cards"), F.col("n")))
    idf = F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw"))
    return met.select(part, question, "term", (F.col("times") * idf).alias("w"), "avgdl")


def term_weights(frequencies: DataFrame, sizes: DataFrame, questions: DataFrame, part: str, question: str, ask: str, floor: float) -> DataFrame:
    """The questions' terms as (part, question, term, w, avgdl), w being idf times the repeats in the question."""
    terms = frequencies.join(sizes, part)
    terms = terms.withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    mean = terms.groupBy(part).agg(F.avg("raw").alias("mean"))
    asked = asked_terms(questions, part, question, ask)
    idf = F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw"))
    return asked.join(terms, [part, "term"]).join(mean, part).select(part, question, "term", (F.col("times") * idf).alias("w"), "avgdl")


def term_share(k1: float, b: float) -> Column:
    """A term's weight in a card."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25(cards: DataFrame, questions: DataFrame, part: str = "country", card: str = "card_id", body: str = "text_en",
         question: str = "item_id", ask: str = "question", k1: float = 1.5, b: float = 0.75, floor: float = 0.25, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Okapi scores (part, question, card, bm25) of every card of a question's partition, 0 without a common term.

    Each partition is a corpus of its own. A negative idf becomes `floor` times the mean idf of the partition's distinct terms. A
    question's repeated words count each time. Every question also asks for the term '' at weight 0, so that the sums by question
    and card have all pairs. They need no shuffle where the asked terms are at most `limit` bytes; beyond that cards are dealt (`meet`)."""
    tf = term_statistics(cards, part, card, body)
    frequencies = tf.where("term <> ''").groupBy(part, "term").agg(F.count("*").alias("df"))
    asked = term_weights(frequencies, lengths(tf, part), questions, part, question, ask, floor)
    none = questions.select(part, question, F.lit("").alias("term"), F.lit(0.0).alias("w"), F.lit(1.0).alias("avgdl"))
    words = questions.select(part, question, F.explode(F.array_distinct(F.concat(text.index_tokens(F.col(ask)), F.array(F.lit(""))))))
    met = meet(tf, asked.unionByName(none), [part, "term"], card, limit, of=words, more=32)
    sums = met.groupBy(part, question, card).agg(F.sum(F.col("w") * term_share(k1, b)).alias("s"))
    return sums.select(part, question, card, F.round("s", DIGITS).alias("bm25"))


def mentions(cards: DataFrame, golds: DataFrame, keys: list[str], body: str, lengths: list[int]) -> DataFrame:
    """`golds` (gold: phrases in normal form of `lengths` words, other columns) with the cards (keys) that hold them as whole words:
    an equi-join on the phrase, so that no pattern meets every text."""
    own = F.array_distinct(F.concat(*[text.phrases(F.col(body), n) for n in lengths]))
    return cards.select(*keys, F.explode(own).alias("gold")).join(golds, "gold")


def dense(queries: DataFrame, cards: DataFrame, part: str, query: str, card: str, a: str, b: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Cosine of unit vectors for every card of a query's partition. Queries of more than `limit` bytes aren't broadcast (`meet`)."""
    q = queries.select(part, query, scores.l2_normalize(F.col(a)).alias("__q"))
    c = dealt(cards, part, card).select(part, card, scores.l2_normalize(F.col(b)).alias("__c"))
    return meet(c, q, [part], card, limit).select(part, query, card, F.round(scores.dot(F.col("__q"), F.col("__c")), DIGITS).alias("dense"))


def normalised(grid: DataFrame, group: list[str]) -> DataFrame:
    """With dn and ln, the min-max forms of dense and bm25 over all cards of a question."""
    return grid.withColumn("dn", scores.minmax(F.col("dense"), *group)).withColumn("ln", scores.minmax(F.col("bm25"), *group))


def hybrid(grid: DataFrame, alpha: float | Column = 0.5) -> DataFrame:
    return grid.withColumn("hybrid", F.round(scores.fuse(F.col("dn"), F.col("ln"), alpha), DIGITS))


def top_k(df: DataFrame, k: int, group: list[str], score: str, card: str = "card_id", out: str = "rank") -> DataFrame:
    ranked = df.withColumn(out, scores.rank_within(group, F.col(score).desc(), F.col(card).asc()))
    return ranked.where(F.col(out) <= k)


def reciprocal_rank_fusion(grid: DataFrame, group: list[str], card: str = "card_id", k: int = 60) -> DataFrame:
    d = scores.rank_within(group, F.col("dense").desc(), F.col(card).asc())
    lx = scores.rank_within(group, F.col("bm25").desc(), F.col(card).asc())
    return fused_ranks(grid.withColumn("rd", d).withColumn("rl", lx), k)


def fused_ranks(ranked: DataFrame, k: int = 60) -> DataFrame:
    """With rrf from the ranks rd and rl."""
    return ranked.withColumn("rrf", F.round(1.0 / (k + F.col("rd")) + 1.0 / (k + F.col("rl")), 9))


def nest(ranked: DataFrame, group: list[str], fields: list[str], out: str = "cards", rank: str = "rank") -> DataFrame:
    """One row per question with its cards as an array in rank order."""
    gathered = F.array_sort(F.collect_list(F.struct(rank, *fields)))
    return ranked.groupBy(*group).agg(F.transform(gathered, lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias(out))


def cut(ranked: DataFrame, tau: float, k: int = 3, score: str = "rerank", rank: str = "rank") -> DataFrame:
    """The first k that reach tau (the order is by the score, so it makes no difference which comes first)."""
    return ranked.where((F.col(rank) <= k) & (F.col(score) >= tau))


def leave_own_out(grid: DataFrame, written_for: str, question: str) -> DataFrame:
    """Without cards that were written for the question itself."""
    return grid.where(~F.coalesce(F.array_contains(F.col(written_for), F.col(question)), F.lit(False)))


def v1(grid: DataFrame, alpha: float = 0.5, k: int = 3) -> DataFrame:
    """Hybrid retrieval: (country, item_id, max_dense, max_bm25, cards). `grid` has dn, ln and each question's maxima, as `blocked.graded` makes them."""
    group = ["country", "item_id"]
    ranked = top_k(hybrid(grid, alpha), k, group, "hybrid")
    cards = F.array_sort(F.collect_list(F.struct("rank", "card_id", "dense", "bm25", "hybrid")))
    return ranked.groupBy(*group, "max_dense", "max_bm25").agg(F.transform(cards, lambda c: c.dropFields("rank")).alias("cards"))


def v2(candidates: DataFrame, questions: DataFrame, tau: float, k: int = 3) -> DataFrame:
    """Reranked candidates to 0..k cards per question; a question without cards keeps an empty array."""
    group = ["country", "item_id"]
    kept = nest(cut(candidates, tau, k), group, ["card_id", "rerank"])
    empty = F.array().cast(kept.schema["cards"].dataType)
    return questions.select(*group).join(kept, group, "left").withColumn("cards", F.coalesce("cards", empty))
