"""Statistics: exact quantiles without gathering a column, summaries, histograms, ranges, extents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.functions.spherical import clamp
from plumbline.session import settle

#: Values that the last step of a quantile search sorts on the driver.
SORTED_VALUES = 20_000
BINS = 4_096


def real(value: Column) -> Column:
    """The value as a double, NULL where it is NaN."""
    return F.nanvl(value.cast("double"), F.lit(None))


def _width(low: float, high: float) -> float:
    return high / BINS - low / BINS  # the difference itself may overflow


def exact_quantiles(frame: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles of one column, as `quantiles_of` finds them."""
    return quantiles_of(frame.select(real(value).alias("v")), ["v"], shares)["v"]


#: Ranks are known to one part in so many after the first scan.
ACCURACY = 10_000


def _values(frame: DataFrame, columns: list[str]) -> DataFrame:
    """c and v of all values of the columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), real(F.col(c)).alias("v")) for c in columns))).alias("x")
    return frame.select(pairs).select("x.*").where("v IS NOT NULL")


def _first_scan(values: DataFrame, shares: list[float]) -> dict[str, Row]:
    """A row for each column: count, infinities, ends, moments, and finite values on both sides of each share's rank, from a
    sketch of bounded size whose ranks are off by less than half the margin."""
    finite = F.abs("v") < float("inf")
    beside = [min(1.0, max(0.0, s + side * 3 / ACCURACY)) for s in shares for side in (-1, 1)]
    sketch = F.percentile_approx(F.when(finite, F.col("v")), beside or [0.5], ACCURACY).alias("beside")
    counts = [F.count("*").alias("n"), F.count_if(F.col("v") == -float("inf")).alias("below"), F.count_if(F.col("v") == float("inf")).alias("above"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high")]
    moments = [F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most")]
    return {r["c"]: r for r in values.groupBy("c").agg(*counts, *moments, sketch).collect()}


def _second_scan(values: DataFrame, summary: dict[str, Row]) -> dict[str, list[tuple[float | None, int]]]:
    """Of each column the distinct values (with their numbers) between the sketch's splitters, and the numbers of values between
    these stretches (value None), in order; nothing where there are too many distinct values."""
    region, inside = F.lit(None).cast("int"), F.lit(False)
    spans: dict[str, list[list[float]]] = {}
    for c, r in summary.items():
        merged: list[list[float]] = []
        for low, high in sorted(zip(r["beside"][::2], r["beside"][1::2])) if r["low"] is not None else ():
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        spans[c] = merged
        own = F.lit(2 * len(merged))
        for k in reversed(range(len(merged))):
            low, high = (F.lit(float(x)) for x in merged[k])
            own = F.when(F.col("v") < low, F.lit(2 * k)).when(F.col("v") <= high, F.lit(2 * k + 1)).otherwise(own)
            inside = inside | (F.col("c") == c) & F.col("v").between(low, high)
        region = F.when(F.col("c") == c, own).otherwise(region)
    most = SORTED_VALUES * sum(map(len, spans.values())) + 2 * len(spans)
    rows = values.where((F.abs("v") < float("inf")) & F.col("c").isin(*spans)).groupBy("c", region.alias("region"), F.when(inside, F.col("v")).alias("v")).count().limit(most + 1).collect()
    if len(rows) > most:
        return {}
    found: dict[str, list[tuple[float | None, int]]] = {c: [] for c in spans}
    for r in sorted(rows, key=lambda r: (r["c"], r["region"], r["v"] or 0.0)):
        found[r["c"]].append((r["v"], r["count"]))
    return found


def quantiles_of(frame: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of columns with linear interpolation between neighbours (as a median's midpoint).

    A built-in exact percentile keeps every distinct value in one task. Here a first scan gives splitters on both sides of
    each wanted rank, from a sketch with a rank guarantee; a second one counts what lies between the splitters' stretches and
    takes the distinct values inside. Where these are more than `SORTED_VALUES` or a rank lies outside after all, intervals
    are narrowed by counts in `BINS` bins, a partial aggregation a pass, until they hold few values. NULLs and NaNs don't
    count; infinities are the first and last ranks. Without values every quantile is None.
    """
    values = _values(frame, columns)
    return _quantiles(values, columns, shares, _first_scan(values, shares))


def _quantiles(values: DataFrame, columns: list[str], shares: list[float], summary: dict[str, Row]) -> dict[str, list[float | None]]:
    infinite = float("inf")
    finite = F.abs("v") < infinite
    found: dict[tuple[str, int], float] = {}
    open_ranks: dict[tuple[str, float, float, int, int], set[int]] = {}  # (column, interval, values in it, values before it)
    for c, r in summary.items():
        inner = r["n"] - r["below"] - r["above"]
        for s in shares:
            at = s * (r["n"] - 1)
            for k in (math.floor(at), math.ceil(at)):
                if k < r["below"]:
                    found[c, k] = -infinite
                elif k >= r["below"] + inner:
                    found[c, k] = infinite
                elif r["low"] == r["high"]:
                    found[c, k] = r["low"]
                else:
                    open_ranks.setdefault((c, r["low"], r["high"], inner, r["below"]), set()).add(k)
    if open_ranks:
        known = _second_scan(values, {key[0]: summary[key[0]] for key in open_ranks})
        for key in list(open_ranks):
            at = key[4]
            for v, n in known.get(key[0], ()):
                own = {k for k in open_ranks[key] if at <= k < at + n} if v is not None else set()
                found |= {(key[0], k): v for k in own}
                open_ranks[key] -= own
                at += n
            if not open_ranks[key]:
                del open_ranks[key]
    while open_ranks:
        few = [x for x in open_ranks if x[3] <= SORTED_VALUES or x[1] + _width(x[1], x[2]) == x[1]]
        for c, low, high, _, before in few:
            ranks = open_ranks.pop((c, low, high, _, before))
            at = before
            for v, n in sorted(map(tuple, values.where((F.col("c") == c) & F.col("v").between(low, high)).groupBy("v").count().collect())):  # equal values are one row
                found |= {(c, k): v for k in ranks if at <= k < at + n}
                at += n
        if not open_ranks:
            break
        keys = list(open_ranks)
        cell = F.lit(None).cast("struct<k:int,cell:bigint>")
        for k, (c, low, high, _, _) in enumerate(keys):
            width = _width(low, high)
            place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
            cell = F.when((F.col("c") == c) & F.col("v").between(low, high), F.struct(F.lit(k).alias("k"), place.alias("cell"))).otherwise(cell)
        counted = values.where(finite).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("cell IS NOT NULL").collect()
        narrowed: dict[tuple[str, float, float, int, int], set[int]] = {}
        for k, key in enumerate(keys):
            before = key[4]
            for r in sorted((r for r in counted if r["cell"]["k"] == k), key=lambda r: r["cell"]["cell"]):
                own = {x for x in open_ranks[key] if before <= x < before + r["n"]}
                if own and r["low"] == r["high"]:
                    found |= {(key[0], x): r["low"] for x in own}
                elif own:
                    narrowed.setdefault((key[0], r["low"], r["high"], r["n"], before), set()).update(own)
                before += r["n"]
        open_ranks = narrowed

    def between(c: str, share: float) -> float | None:
        if c not in summary:
            return None
        at = share * (summary[c]["n"] - 1)
        a, b = found[c, math.floor(at)], found[c, math.ceil(at)]
        return a if a == b else a + (b - a) * (at - math.floor(at))

    return {c: [between(c, s) for s in shares] for c in columns}


def grouped_median(frame: DataFrame, key: str, value: str, most: int = SORTED_VALUES, bins: int = 256) -> DataFrame:
    """key and the exact median of its finite values, without more than `most` values of a group in one task.

    Groups of up to `most` values take the built-in median. For the others the interval of either middle rank is narrowed
    by counts in bins, a partial aggregation for all groups at once, until it holds few values or one.
    """
    values = frame.select(F.col(key).alias("__key"), real(F.col(value)).alias("v")).where(F.abs("v") < float("inf"))
    sizes = settle(values.groupBy("__key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    large = sizes.where(F.col("n") > most)
    if not large.limit(1).count():
        return values.groupBy("__key").agg(F.median("v").alias("median")).withColumnRenamed("__key", key)
    small = values.join(sizes.where(F.col("n") <= most).select("__key"), "__key", "left_semi").groupBy("__key").agg(F.median("v").alias("median"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    state = large.select("__key", middle, "low", "high", "n")  # rank: among the n values of the interval
    settled = None
    width = F.col("high") / bins - F.col("low") / bins
    while True:
        state = settle(state)
        narrow = (F.col("n") <= most) | (F.col("low") + width == F.col("low"))
        done = state.where(narrow)
        settled = done if settled is None else settled.unionByName(done)
        wide = state.where(~narrow)
        if not wide.limit(1).count():
            break
        cell = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1)).alias("cell")
        inside = values.join(wide.drop("n"), "__key").where(F.col("v").between(F.col("low"), F.col("high")))
        counted = inside.groupBy("__key", "rank", cell).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("__key", "rank").orderBy("cell")) - F.col("n")  # `bins` rows for each rank
        placed = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        state = placed.select("__key", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "n")
    ends = values.join(settled.drop("n"), "__key").where(F.col("v").between(F.col("low"), F.col("high"))).groupBy("__key", "rank", "low", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("__key", "rank", "low").orderBy("v"))  # `most` distinct values at most
    picked = ends.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("k") <= F.col("rank")))
    return small.unionByName(picked.groupBy("__key").agg(F.avg("v").alias("median"))).withColumnRenamed("__key", key)


def nmad(frame: DataFrame, value: Column) -> tuple[float | None, float | None]:
    """(median, normalised median absolute deviation), exact."""
    (median,) = exact_quantiles(frame, value, [0.5])
    if median is None:
        return None, None
    (mad,) = exact_quantiles(frame, F.abs(value - F.lit(median)), [0.5])
    return median, C.NMAD_FACTOR * mad


def column_stats(frame: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (of all values, ddof 0), max, min, median: one row for each column that has values."""
    values = _values(frame, columns)
    summary = _first_scan(values, [0.5])
    medians = _quantiles(values, columns, [0.5], summary)
    rows = [(c, r["n"], r["mean"], r["std"], r["most"], r["least"], medians[c][0]) for c, r in summary.items()]
    return frame.sparkSession.createDataFrame(rows, "column string, n long, mean double, std double, max double, min double, median double")


def histogram(frame: DataFrame, value: Column, bins: int, density: bool = True) -> DataFrame:
    """bin, low, high, n (and density) of equal bins between least and largest value; the last bin is closed."""
    values = frame.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    spark = frame.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long" + (", density double" if density else ""))
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    filled = every.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    if not density:
        return filled
    total = values.count()
    return filled.withColumn("density", F.col("n") / F.lit(total * width))


def normal_curve(spark, mean: float, std: float, low: float, high: float, points: int = 1000) -> DataFrame:
    """x and the normal density, for drawing over a histogram."""
    x = F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))
    z = (F.col("x") - F.lit(mean)) / F.lit(std)
    return spark.range(points).select(x.alias("x")).withColumn("density", F.exp(-z * z / 2e0) / F.lit(std * math.sqrt(2 * math.pi)))


def clip(value: Column, low: float, high: float) -> Column:
    return clamp(value, low, high)


def clip_p95(frame: DataFrame, column: str, name: str) -> DataFrame:
    """The column with its upper end cut at the 95th percentile."""
    (top,) = exact_quantiles(frame, F.col(column), [0.95])
    return frame.withColumn(name, F.when(F.col(column) > F.lit(top), F.lit(top)).otherwise(F.col(column)))


def extent(frame: DataFrame, margin: float = 0.3) -> DataFrame:
    """West, east, south, north of the points with a margin."""
    return frame.agg((F.min("lon") - margin).alias("west"), (F.max("lon") + margin).alias("east"), (F.min("lat") - margin).alias("south"), (F.max("lat") + margin).alias("north"))


def finite_range(frame: DataFrame, column: str) -> DataFrame:
    """Least and largest finite value, 1e-6 apart from the value on both sides where they are equal."""
    x = F.col(column)
    real = frame.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    lo, hi = F.col("lo"), F.col("hi")
    return real.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.when(lo == hi, lo - 1e-6).otherwise(lo).alias("low"), F.when(lo == hi, hi + 1e-6).otherwise(hi).alias("high"))


def clean_stats(frame: DataFrame, value: str, outlier: str = "is_outlier") -> DataFrame:
    """Least, largest, mean, std (ddof 1) of what isn't an outlier, and both counts."""
    v = F.when(~F.col(outlier), F.col(value))
    return frame.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n_clean"), F.count_if(F.col(outlier)).alias("n_outliers"))


def null_count(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.count_if(F.col(column).isNull() | F.isnan(column)).alias("n_missing"))
