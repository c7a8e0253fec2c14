"""Micro-batch intake of new observations: the row-local steps of the removal, on a stream.

The batch pipeline needs no streaming; these steps have no state, so the same expressions serve a stream unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import gravity as G
from plumbline.roles import OBSERVATION
from plumbline.session import checkpoint_folder


def read_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(OBSERVATION).parquet(folder)


def with_disturbance(stream: DataFrame) -> DataFrame:
    """Observations with normal gravity, disturbance and atmospheric correction; rows without a number keep NULL."""
    lat, h = F.col("lat"), F.col("h")
    return stream.withColumn("gamma_h", G.gravity_at_height(lat, h)).withColumn("disturbance", G.disturbance(F.col("g"), lat, h)).withColumn("atmosphere", G.atmospheric_correction(h))


def write_disturbances(spark: SparkSession, source: str, target: str, name: str = "disturbances") -> StreamingQuery:
    """Process what has arrived and stop; run again to go on where it ended."""
    stream = with_disturbance(read_observations(spark, source))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{checkpoint_folder(spark).rstrip('/')}/stream-{name}").trigger(availableNow=True).start()
