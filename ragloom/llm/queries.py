"""The queries of this subpackage over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cross_parse, fm_index, html_wrapper, jaccard_join, join_view, licenses, lm_score, merkle, mixture, multiset_hash, token_attribution, token_store, toxicity
from .common import read


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op2_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.choose(read(spark, sf_dir, "documents"))


def op3_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(read(spark, sf_dir, "documents"))
    return token_store.documents_of(store)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(read(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.count(read(spark, sf_dir, "documents"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.report(read(spark, sf_dir, "documents"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return fm_index.digest(found)


def op11_join_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_view.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents"))


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return cross_parse.identify(docs, cross_parse.train(docs))


def queries() -> dict:
    own = [op1_stupid_backoff, op2_hierarchical_mixture, op3_bit_plane_tokens, op4_toxicity, op5_wrapper_induction, op6_license_scan, op7_token_attribution, op8_jaccard_components, op9_multiset_fingerprints, op10_fm_decontamination, op11_join_view, op12_merkle_manifest, op13_cross_parsing]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_stupid_backoff": lm_score.oracle_sql(), "op2_hierarchical_mixture": mixture.oracle_sql(), "op11_join_view": join_view.oracle_sql(),
        "op12_merkle_manifest": merkle.oracle_sql(),
    }
