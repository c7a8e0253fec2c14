"""Height checks and comparison of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import gravity as G


def three_sigma_by_height(points: DataFrame, difference: str = "difference", height: str = "h", split: float = 2000.0) -> DataFrame:
    """Points with their height class and `kept`: true inside the bounds of the class, false outside, NULL on a bound.

    The bounds are -(mean + 3 std) and mean + 3 std of the class, std with ddof 1: not symmetric about the mean, on purpose.
    """
    classed = points.withColumn("height_class", F.when(F.col(height) >= split, "high").when(F.col(height) < split, "low"))
    bounds = classed.groupBy("height_class").agg((F.avg(difference) + 3e0 * F.stddev_samp(difference)).alias("bound"))
    d, b = F.col(difference), F.col("bound")
    return classed.join(F.broadcast(bounds), "height_class").withColumn("kept", F.when((d > -b) & (d < b), True).when((d < -b) | (d > b), False)).drop("bound")  # two classes


def height_check(points: DataFrame) -> DataFrame:
    """Difference of given and sampled height, its type, and the three-sigma verdict; rows without one are left out."""
    diff = points.withColumn("difference", F.col("h") - F.col("sampled")).where("difference IS NOT NULL")
    return three_sigma_by_height(diff.withColumn("height_type", G.height_type(F.col("difference"))))


def project_bias(points: DataFrame, value: str = "difference") -> DataFrame:
    """Mean and std (ddof 1) of each project."""
    return points.groupBy("project").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def reference_project(points: DataFrame, value: str = "difference") -> DataFrame:
    """The project whose mean is nearest to zero; of equal ones the first by name."""
    means = project_bias(points, value)
    return means.agg(F.min(F.struct(F.abs("mean").alias("off"), F.col("project").alias("project"))).alias("x")).select(F.col("x.project").alias("project"), F.col("x.off").alias("abs_mean"))


def satop_ranking(points: DataFrame, value: str = "disturbance", model: str = "ggm", terrain: str = "topo") -> DataFrame:
    """Projects by |mean| of what is left after model and terrain, nearest to zero first."""
    left = points.withColumn("difference", G.satop_difference(F.col(value), F.col(model), F.col(terrain)))
    return project_bias(left).withColumn("rank", F.expr("row_number() OVER (ORDER BY abs(mean), project)"))
