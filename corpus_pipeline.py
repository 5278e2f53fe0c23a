"""Corpus pipeline: stages over the documents table, each written as Parquet and read again.

Language identification drops documents without a recognised language; of each class of
near-duplicates one document stays; documents with benchmark passages in a twentieth of their words
or more are dropped; personal data is replaced by its kind; the texts are encoded into pieces and
decoded again. All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontamination, language, minhash, pieces, pii
from trackloom.llm.common import table
from trackloom.session import scratch_path


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs, language.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_per_class(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, ids="ids", decoded="decoded")


STAGES = [
    ("language", recognised),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("personal_data", redacted),
    ("pieces", encoded),
]
#: Network, signature and random-field stages are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
