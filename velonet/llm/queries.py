"""The registered queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontam, langid, lm_score, packing, pii, quality_classifier, quality_rules, secret_scan, simhash, spelling, substring_dedup, url_filter
from .common import small_batches, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=50)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), most=1024)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality_rules.judged(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much like the conversations each document reads."""
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.repair(conversation_repair.damaged(talks)), talks)


def bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session whose Arrow batches are small: so the memory of each is the same whichever ran before."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark.range(0))
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: bounded(f)
    for f in (
        op1_quality_classifier, op2_substring_dedup, op3_pii, op4_packing, op5_decontamination, op6_language_id, op7_simhash, op8_quality_rules, op9_url_filter, op10_lm_score,
        op11_spelling_variants, op12_secret_scan, op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {"op9_url_filter": url_filter.oracle_sql()}
