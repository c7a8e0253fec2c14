"""Binary files through Spark's own writers and readers: any store Spark reaches, and tasks that commit or vanish whole.

The text sink writes the bytes of a value as they are and ends each with the line separator. What separates records in a
binary format therefore goes there: an end id in flat token files, a random marker between segments, as in other formats
whose files can be entered anywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own on the shared storage."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def empty_folder(spark: SparkSession, folder: str) -> None:
    """Let go of a scratch folder's files: an empty result takes their place."""
    spark.createDataFrame([], "value string").write.mode("overwrite").text(folder)


def write_payloads(rows: DataFrame, folder: str, separator: str, kind_col: str | None = None, rows_per_file: int = 0) -> None:
    """The rows' `payload` in their order, each followed by the separator, under kind=... where `kind_col` is named; a file
    for each task, or several of so many rows."""
    chosen = rows.select(*([F.col(kind_col).alias("kind")] if kind_col else []), F.col("payload").cast("string").alias("value"))
    writer = chosen.write.option("lineSep", separator).option("maxRecordsPerFile", rows_per_file).option("compression", "none")
    (writer.partitionBy("kind") if kind_col else writer).text(folder)


def read_segments(spark: SparkSession, folder: str, separator: str) -> DataFrame:
    """`content` of each record in the files; Spark cuts them into byte ranges, and a range begins at its first separator."""
    return spark.read.option("lineSep", separator).text(folder).select(F.col("value").cast("binary").alias("content"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """part and seq (numbers in the file's name, in the order of writing), content of whole files."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long").alias("part"),
        F.regexp_extract(name, r"c(\d+)\.[a-z]+$", 1).cast("long").alias("seq"),
        "content",
    )
