"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A document is the multiset of its paragraphs (the pieces between line breaks). Its fingerprint is a wide vector summed
over paragraphs:

* `SUM_LANES` lanes of 32 bits: the paragraph's SHA-256, cut into 32-bit words, summed modulo 2^32. Equal multisets have
  equal lanes, in whatever order the paragraphs come; other multisets agree by chance only.
* `SIGN_LANES` lanes of 32 bits: the paragraph's own vector, which is the sum of sign vectors of its clauses (its pieces between
  `.` and `,`), each sign a bit of the clause's MD5, summed modulo 2^32, which no text has clauses enough to wrap. Inner products of these lanes estimate
  how much two documents share, so their cosine is the fingerprints' likeness; equal fingerprints have likeness 1.

Both are sums, so `add` and `remove` update a fingerprint from fingerprints of what comes or goes, without the document.
The string has the lanes in order, in lower-case hex, 8 digits each.

Defined results: a null text is an empty one, which has one empty paragraph and no clause; repeated rows have equal fingerprints; with
repeated doc_ids the next document is the next row by (doc_id, text); a null doc_id counts as the lowest; an only
document is its own next; texts of any length are hashed whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SUM_LANES = 8
SIGN_LANES = 64
HALF, MODULUS = 1 << 31, 1 << 32
#: Two lanes' counts of set bits share a 64-bit sum, 32 bits each, which would carry beyond 2^31 clauses only.
ROWS_PER_BUCKET = 1_500
#: Text of a shuffle partition.
PARTITION_BYTES = 32_000_000


def fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sums array<long>, signs array<long>) of each row of `docs` (keys, text), whose keys are unique: lanes as
    residues. A row's pieces stay in its task until they are summed; only sums are shuffled."""
    paragraphs = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit(True).alias("whole"), x.alias("s")))
    split = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: F.split(x, "[.,]+ *")))
    clauses = F.transform(split, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("s")))
    pieces = docs.select(*keys, F.explode(F.concat(paragraphs, F.filter(clauses, lambda c: c["s"] != ""))).alias("piece"))
    hashed = pieces.select(*keys, "piece.whole", F.when(F.col("piece.whole"), F.sha2("piece.s", 256)).otherwise(F.md5("piece.s")).alias("h"))
    lane = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    wide = hashed.select(
        *keys, "whole", lane(0).alias("a"), lane(1).alias("b"), *[F.when(F.col("whole"), lane(i)).otherwise(0).alias(f"l{i}") for i in range(SUM_LANES)]
    )
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
    pair = lambda i: bit("a", i) + F.shiftleft(bit("b", i), 32)
    out = wide.groupBy(*keys).agg(
        F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("clauses"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(SUM_LANES)],
        *[F.sum(F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(pair(i))).alias(f"c{i}") for i in range(32)],
    )
    signs = [2 * F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("clauses") for i in range(32)]
    signs += [2 * F.shiftright(f"c{i}", 32) - F.col("clauses") for i in range(32)]
    sums = [F.col(f"l{i}") % MODULUS for i in range(SUM_LANES)]
    return out.select(*keys, F.array(*sums).alias("sums"), F.array(*[F.pmod(x, F.lit(MODULUS)) for x in signs]).alias("signs"))


def text_form(sums, signs) -> F.Column:
    lanes = lambda a: F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    return F.concat(lanes(sums), lanes(signs))


def from_text(fingerprint) -> tuple[F.Column, F.Column]:
    """The lanes of a fingerprint's string."""
    cut = lambda start, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(fingerprint, F.lit(start + 1) + i * 8, F.lit(8)), 16, 10).cast("long"))
    return cut(0, SUM_LANES), cut(8 * SUM_LANES, SIGN_LANES)


def _combine(x, y, sign: int) -> F.Column:
    (xs, xc), (ys, yc) = from_text(x), from_text(y)
    move = lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.pmod(z["a"] + sign * z["b"], F.lit(MODULUS)))
    return text_form(move(xs, ys), move(xc, yc))


def add(fingerprint, inserted) -> F.Column:
    """Fingerprint of a document after the paragraphs of fingerprint `inserted` were added to it."""
    return _combine(fingerprint, inserted, 1)


def remove(fingerprint, deleted) -> F.Column:
    return _combine(fingerprint, deleted, -1)


def likeness(sums, signs, other_sums, other_signs) -> F.Column:
    """Cosine of the sign lanes, from 0 to 1; 1 for equal fingerprints."""
    signed = lambda a: F.transform(a, lambda x: F.when(x >= HALF, x - MODULUS).otherwise(x).cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own, other = signed(signs), signed(other_signs)
    norm = dot(own, own) * dot(other, other)
    cosine = F.when(norm > 0, dot(own, other) / F.sqrt(norm)).otherwise(F.lit(0.0))
    same = (sums == other_sums) & (signs == other_signs)
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`docs` (doc_id, text) as rows (bucket, place) in ascending order, with the text of the next row and, on the last row
    of a bucket, the bucket that holds it; the first row follows the last.

    One shuffle: rows go to ranges of doc_id, cut at its quantiles, in each of which a window looks one row ahead. The next of
    a range's last row is the first of the next range that has rows; there is one such row per range."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    docs = common.with_range(docs, "doc_id", "bucket", n, rows_per_bucket)
    order = "partition by bucket order by doc_id nulls first, text"
    dealt = docs.repartition(common.parts_for(docs.sparkSession, size or 0, PARTITION_BYTES), "bucket")
    placed = dealt.selectExpr(
        "doc_id", "bucket", "text", f"row_number() over ({order}) as place", f"lead(text) over ({order}) as ahead"
    )
    spans = docs.select("bucket").distinct().withColumn("span", F.floor(F.col("bucket") / 512))
    firsts = spans.groupBy("span").agg(F.min("bucket").alias("first"))
    firsts = firsts.selectExpr("span", "coalesce(lead(first) over (order by span), min(first) over ()) as following")
    after = "coalesce(lead(bucket) over (partition by span order by bucket), following)"
    after = spans.join(firsts, "span").selectExpr("bucket", f"{after} as next_bucket")
    # from `docs`, where each task leaves one row of a range before anything moves
    heads = docs.selectExpr("bucket as next_bucket", "text as head", f"row_number() over ({order}) as place").where("place = 1").drop("place")
    heads = heads.join(after, "next_bucket").selectExpr("bucket as b", "next_bucket", "head")
    joined = placed.join(heads, (F.col("bucket") == F.col("b")) & F.col("ahead").isNull(), "left")
    return joined.selectExpr("doc_id", "bucket", "place", "next_bucket", "text", "coalesce(ahead, head) as next_text")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns. A row's text and its edited text are two documents to fingerprint; the next document's
    fingerprint comes from the row ahead among the narrow results."""
    placed = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half))
    versions = F.array(
        F.struct(F.lit(False).alias("edited"), F.lit("").alias("sha"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("edited"), F.sha2(edited, 256).alias("sha"), edited.alias("text")),
    )
    keys = ["doc_id", "bucket", "place", "next_bucket", "n_chars", "edited", "sha"]
    rows = placed.select("doc_id", "bucket", "place", "next_bucket", F.length("text").cast("long").alias("n_chars"), F.inline(versions))
    found = common.materialise(fingerprints(rows, keys), "fingerprints")
    own = found.where("not edited").drop("edited", "sha")
    other = found.where("edited").selectExpr("bucket", "place", "sha as edited_sha256", "sums as e_sums", "signs as e_signs")
    order = "partition by bucket order by place"
    ahead = own.selectExpr("*", f"lead(sums) over ({order}) as a_sums", f"lead(signs) over ({order}) as a_signs")
    heads = own.where("place = 1").selectExpr("bucket as next_bucket", "sums as h_sums", "signs as h_signs")
    all_of = ahead.join(heads, "next_bucket", "left").join(other, ["bucket", "place"])
    n_sums, n_signs = F.coalesce("a_sums", "h_sums"), F.coalesce("a_signs", "h_signs")
    return all_of.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("sums"), F.col("signs")).alias("fingerprint"),
        text_form(F.col("e_sums"), F.col("e_signs")).alias("edited_fingerprint"),
        likeness(F.col("sums"), F.col("signs"), F.col("e_sums"), F.col("e_signs")).alias("near_edited"),
        likeness(F.col("sums"), F.col("signs"), n_sums, n_signs).alias("near_next"),
    )
