"""What every operator needs from the session: checkpoints on shared storage and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; only where it is unset on a local master (tests) one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: Spark's setting by which an execution's shuffle files go when it has ended.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(frame: DataFrame) -> DataFrame:
    """The rows of `frame`, computed once and kept on shared storage: lost executors cost no recomputation, and the shuffle
    files that led to the rows go at once."""
    checkpoint_folder(frame.sparkSession)
    conf = frame.sparkSession.conf
    before = conf.get(FILES_GO, None)
    conf.set(FILES_GO, "true")
    try:
        return frame.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        conf.unset(FILES_GO) if before is None else conf.set(FILES_GO, before)


#: Bytes of an Arrow batch sent to Python: rows may be whole books.
ARROW_BATCH = "8m"


def ship_package(spark: SparkSession) -> None:
    """Get a session ready for Python stages: Arrow batches bounded in bytes, and this package on the executors (once per
    session, for clusters where it is not installed)."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    if getattr(context, "_plumbline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="plumbline-package-")
    target = os.path.join(folder, "plumbline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(target)
    context._plumbline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
