"""Text tables: tab-separated with coercion, blank-separated without header, sniffed separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.roles import MissingColumnsError
from plumbline.session import settle

BOM = "\ufeff"


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return "" if row is None else row[0].lstrip(BOM)


def read_table(spark: SparkSession, path: str, separator: str = "\t", numbers: list[str] | None = None) -> DataFrame:
    """Columns as text, under the header's names without a byte-order mark; those in `numbers` as doubles, bad ones NULL."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False, encoding="UTF-8")
    frame = raw.toDF(*(c.lstrip(BOM).strip() for c in raw.columns))
    missing = [n for n in numbers or [] if n not in frame.columns]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; there are {frame.columns}")
    return frame.withColumns({n: F.nanvl(F.expr(f"try_cast(trim(`{n}`) AS DOUBLE)"), F.lit(None).cast("double")) for n in numbers or []})


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab, semicolon, comma or blanks, by what the header has."""
    head = first_line(spark, path)
    return next((s for s in ("\t", ";", ",") if s in head), " ")


def read_sniffed(spark: SparkSession, path: str, numbers: list[str] | None = None) -> DataFrame:
    """A table with header whose separator is found from its first line; blanks in any number if none is there."""
    separator = sniff_separator(spark, path)
    if separator != " ":
        return read_table(spark, path, separator, numbers)
    return read_blank_separated(spark, path, first_line(spark, path).split(), header=True)


def read_blank_separated(spark: SparkSession, path: str, names: list[str], header: bool = False) -> DataFrame:
    """Numbers separated by blanks; the header's line, if there is one, is the line that equals the names."""
    parts = F.split(F.trim(F.regexp_replace("value", BOM, "")), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts.alias("p"))
    if header:
        rows = rows.where(~F.col("p").eqNullSafe(F.array(*(F.lit(n) for n in names))))
    return rows.select(*(F.get("p", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def read_synthesis(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, h, value of a synthesis result."""
    return read_blank_separated(spark, path, ["lat", "lon", "h", "value"])


def read_undulations(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, undulation of a geoid expansion."""
    return read_blank_separated(spark, path, ["lat", "lon", "undulation"])


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """i and value of files with a number on each line, in the order of the files' names and of their lines. Files may be of
    any size: lines are numbered within the blocks that Spark reads, and blocks after one another."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    lines = settle(lines.where(F.length(F.trim("value")) > 0))
    blocks = lines.groupBy("f", "b").agg(F.count("*").alias("n"))
    starts = blocks.select("f", "b", (F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).alias("start"))  # a row for each block of 128 MB
    placed = lines.withColumn("local", F.row_number().over(Window.partitionBy("f", "b").orderBy("k"))).join(starts, ["f", "b"])
    return placed.select((F.col("start") + F.col("local")).alias("i"), F.trim("value").try_cast("double").alias("value"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weight history: a row for each iteration, comma-separated, without header; w0, w1 ... in the file's order."""
    columns = len(first_line(spark, path).split(","))
    return spark.read.csv(path, header=False, schema=", ".join(f"w{i} double" for i in range(columns)))


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """project and sigma2, separated by a tab or blanks; the number stands last."""
    line = F.trim("value")
    return spark.read.text(path).where(F.length(line) > 0).select(F.trim(F.regexp_extract("value", r"^\s*(.*?)[\t ]+\S+\s*$", 1)).alias("project"), F.regexp_extract("value", r"(\S+)\s*$", 1).try_cast("double").alias("sigma2"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """design, observations, split of a list of groups."""
    from plumbline.functions.text import is_true

    raw = spark.read.csv(path, sep="\t", header=False).toDF("design", "observations", "split")
    return raw.withColumn("split", is_true(F.col("split")))


def read_gfc(spark: SparkSession, path: str) -> DataFrame:
    """n, m, c, s of a geopotential model in the ICGEM text format; D exponents are read too."""
    p = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.regexp_replace(F.get("p", F.lit(k)), "[dD]", "e").try_cast("double")
    rows = spark.read.text(path).select(p.alias("p")).where(F.get("p", F.lit(0)).isin("gfc", "gfct"))
    return rows.select(F.get("p", F.lit(1)).cast("int").alias("n"), F.get("p", F.lit(2)).cast("int").alias("m"), number(3).alias("c"), F.coalesce(number(4), F.lit(0e0)).alias("s"))


def gfc_constants(spark: SparkSession, path: str) -> tuple[float, float]:
    """(GM, radius) from the header of a geopotential model; both must be there."""
    p = F.split(F.trim("value"), r"\s+")
    names = {"earth_gravity_constant": "gm", "gravity_constant": "gm", "radius": "radius"}
    rows = spark.read.text(path).select(F.get(p, F.lit(0)).alias("name"), F.regexp_replace(F.get(p, F.lit(1)), "[dD]", "e").try_cast("double").alias("value"))
    found = {names[r["name"]]: r["value"] for r in rows.where(F.col("name").isin(*names) & F.col("value").isNotNull()).limit(len(names)).collect()}
    if set(found) != {"gm", "radius"}:
        raise ValueError(f"{path} names no {' and no '.join(sorted({'gm', 'radius'} - set(found)))}")
    return found["gm"], found["radius"]
