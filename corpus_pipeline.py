"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents, extra ones included. Running the stages writes each one's rows as Parquet and reads them again for the
next; a stage's files go when the stage after the next has read what it needs.

Null and empty texts are documents like others: the classifier scores them, they are alike to nothing, hold no benchmark
passages and no secrets, and are packed as the end id alone. Of rows that repeat an id one stays, rows without an id all
stay. Ties go to the least id. Empty tables of documents give no sequences; without labels the classifier rejects nothing
but where all labels are 0, without benchmark items nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, minhash, packing, quality, secrets
from plumbline.llm.flatfiles import empty_folder, new_folder
from plumbline.session import table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    return minhash.keep_one(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain passages of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; secrets in their texts are replaced by a mark and n_chars is counted anew."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces placed in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_overlaps),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Classifier, sampling and packing aren't SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from documents."""
    docs = table(spark, sf_dir, "documents")
    before: str | None = None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            empty_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
