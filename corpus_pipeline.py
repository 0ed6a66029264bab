"""A corpus pipeline of the training-data operators, stage by stage over ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from velonet.llm import common, decontam, packing, pii, quality_rules, simhash
from velonet.llm.queries import tokenizer_path
from velonet.session import checkpoint_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go.

    Null and empty texts go; repeated rows and null ids are judged like others; an empty table stays empty.
    """
    return quality_rules.filtered(docs, quality_rules.train(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles overlap by 0.8 or more, transitively, the one with the smallest id stays.

    Null and empty texts are alike; of rows equal in id and text one stays; rows with a null id stay; an empty table stays
    empty.
    """
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows and null ids are searched like others; empty tables are fine.
    """
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to tags; ``n_chars`` follows.

    Null texts stay null; repeated rows and null ids are treated like others; an empty table stays empty.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut into sequences of binary length, with their token ids.

    A null or empty text gives the final id alone; repeated rows and null ids are packed like others; an empty table gives
    no rows.
    """
    return packing.pieces(docs, tokenizer_path(), keep_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("packing", pack),
]

#: SQL cannot express the forest, the fingerprints or the tokenizer: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order; each result is written as Parquet in the shared folder and read again.

    A stage's result is deleted once the next one is written; the last one stays, as the rows returned are read from it.
    """
    base = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
