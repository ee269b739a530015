"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
`docs`. All but the last return the columns of `documents`, extra columns included.

Defined results: rows with a null or empty text are clean and stay, up to mixing, which may leave them out like any other; rows whose
text decontamination empties go; repeated rows are one group of copies, of which one row stays, but rows without a word are
linked with nothing and all stay; a null doc_id counts as the lowest; empty tables give empty results; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import common, fm_index, jaccard_join, mixture, token_store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from the labelled ones among `docs`."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets that links of Jaccard similarity 0.8 connect."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every window of ten benchmark words is cut out; `n_chars` follows. Documents without text left go."""
    cut = fm_index.remove(docs, common.read(spark, sf_dir, "benchmark"))
    n_chars = F.length("text").cast("long").alias("n_chars")
    return cut.select(*[n_chars if c == "n_chars" else F.col(common.quoted(c)) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens by the target weights, each document once at most."""
    return mixture.select(docs, numerator=9, denominator=10, max_epochs=1)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token store, read back from it."""
    return token_store.documents_of(token_store.write(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID output", write_tokens),
]

#: A trained model and a tokenizer decide the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
