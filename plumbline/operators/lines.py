"""Flight lines: low-pass filter, statistics, distances, distance subsampling."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.spherical import cos_distance, gaussian_b, gaussian_weight, haversine
from plumbline.session import settle, ship_package

#: Lines of more points than this are filtered in blocks of points.
LONG_LINE = 2_000
BLOCK = 1_000
#: Weights below this don't reach the last digit of a mean: every point weighs 1 in its own.
LEAST_WEIGHT = 1e-18
#: Lines of more points than this are ordered in blocks: no window then holds more than a task's share of a line.
WINDOW_LINE = 1_000_000
#: Targets of the subsampling that one running maximum goes over.
TARGET_BLOCK = 100_000
NO_PROJECT = "(sin proyecto)"


def _usable(value: str) -> Column:
    x = [F.col("lat"), F.col("lon"), F.col(value)]
    ok = F.col("project").isNotNull() & F.col("line").isNotNull()
    for c in x:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def gaussian_filter(obs: DataFrame, half_width_km: float, value: str = "g", name: str = "filtered", long_line: int = LONG_LINE) -> DataFrame:
    """The rows with a Gaussian mean of `value` over all points of the same project and line.

    Rows without finite position or value, or without project or line, stay with NULL and don't touch the others. Lines of
    up to `long_line` points are self-joined on (project, line) inside generated code; the points of longer ones are packed
    in blocks of neighbours and every pair of blocks within reach is a row of its own, so the work of one line is spread
    over the cluster and follows its length.
    """
    b = gaussian_b(half_width_km)
    points = obs.where(_usable(value)).select("obs_id", "project", "line", "seq", F.radians("lat").alias("phi"), F.radians("lon").alias("lam"), F.col(value).cast("double").alias("v"))
    points = points.select("obs_id", "project", "line", "seq", "lam", "v", F.sin("phi").alias("s"), F.cos("phi").alias("c"))
    sizes = points.groupBy("project", "line").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    if longest <= long_line:
        means = _joined_means(points, b)
    else:
        long = sizes.where(F.col("n") > long_line).select("project", "line")
        means = _joined_means(points.join(long, ["project", "line"], "left_anti"), b).unionByName(_block_means(points.join(long, ["project", "line"], "left_semi"), b))
    return obs.join(means.withColumnRenamed("mean", name), "obs_id", "left")


def _joined_means(points: DataFrame, b: float) -> DataFrame:
    other = points.select("project", "line", *(F.col(x).alias(f"{x}2") for x in ("lam", "v", "s", "c")))
    w = gaussian_weight(cos_distance(F.col("s"), F.col("c"), F.col("s2"), F.col("c2"), F.col("lam") - F.col("lam2")), b)
    return points.join(other, ["project", "line"]).withColumn("w", w).groupBy("obs_id").agg((F.sum(F.col("w") * F.col("v2")) / F.sum("w")).alias("mean"))


def _block_means(points: DataFrame, b: float) -> DataFrame:
    """Means from pairs of blocks of neighbouring points. Pairs so far apart that no weight reaches `LEAST_WEIGHT` are left
    out: they are told from the blocks' centres and radii, before any points are joined."""
    ship_package(points.sparkSession)
    ordered = settle(points.repartitionByRange("project", "line", "seq", "obs_id").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("project", "line", "part").orderBy("seq", "obs_id")
    dealt = ordered.withColumn("block", F.struct("part", F.floor((F.row_number().over(order) - 1) / BLOCK).alias("k")))
    unit = [F.col("c") * F.cos("lam"), F.col("c") * F.sin("lam"), F.col("s")]
    packed = dealt.groupBy("project", "line", "block").agg(F.collect_list(F.struct("obs_id", "lam", "v", "s", "c")).alias("p"), *(F.avg(u).alias(n) for u, n in zip(unit, "xyz", strict=True)))
    packed = settle(packed.select("project", "line", "block", "x", "y", "z", *(F.col(f"p.{n}").alias(n) for n in ("obs_id", "lam", "v", "s", "c"))))
    # chord from the centre to the farthest point: the triangle inequality holds for chords
    chord = F.transform(F.arrays_zip("lam", "s", "c"), lambda q: F.sqrt(F.pow(q["c"] * F.cos(q["lam"]) - F.col("x"), F.lit(2)) + F.pow(q["c"] * F.sin(q["lam"]) - F.col("y"), F.lit(2)) + F.pow(q["s"] - F.col("z"), F.lit(2))))
    balls = settle(packed.select("project", "line", "block", "x", "y", "z", F.array_max(chord).alias("r")))
    reach = (-2 * np.log(LEAST_WEIGHT) / b) ** 0.5  # 1 - cos of an angle is half the squared chord
    near = balls_in_reach(balls, float(reach)).select("project", "line", "block", "block2")
    own = packed.select("project", "line", "block", "obs_id", "lam", "s", "c")
    source = packed.select("project", "line", F.col("block").alias("block2"), *(F.col(n).alias(f"{n}2") for n in ("lam", "v", "s", "c")))
    pairs = near.join(own, ["project", "line", "block"]).join(source, ["project", "line", "block2"]).select("obs_id", "lam", "s", "c", "lam2", "v2", "s2", "c2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lam, s, c, lam2, v2, s2, c2 = (np.asarray(batch.column(n)[k].values) for n in range(8))
                cos = np.clip(np.outer(s, s2) + np.outer(c, c2) * np.cos(lam[:, None] - lam2), -1, 1)
                w = np.exp(-b * (1 - cos))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w.sum(1)), pa.array(w @ v2)], names=["obs_id", "w", "wv"])

    sums = pairs.mapInArrow(run, "obs_id long, w double, wv double")
    return sums.groupBy("obs_id").agg((F.sum("wv") / F.sum("w")).alias("mean"))


def balls_in_reach(balls: DataFrame, reach: float) -> DataFrame:
    """Ordered pairs (project, line, block, block2) of balls (x, y, z, r) of one line that are at most `reach` apart, each with itself
    too.

    Balls live in grids whose cells double in side from level to level; a ball's level has cells as wide as the ball and its
    reach. A ball that meets one of its own or a higher level lies in a cell beside that one's there, so an equi-join on
    cells meets neighbours only, however long the line.
    """
    level = F.greatest(F.ceil(F.log2((F.col("r") * 2 + F.lit(reach)) / F.lit(reach))), F.lit(0)).cast("int")
    placed = balls.withColumn("level", level)
    top = placed.agg(F.max("level")).first()[0]
    if top is None:
        return balls.select("project", "line", "block", F.col("block").alias("block2"))
    keys = ["project", "line", "at", "i", "j", "k"]

    def cells(frame: DataFrame, shift: dict[str, Column]) -> DataFrame:
        side = F.lit(reach) * F.pow(F.lit(2e0), F.col("at"))
        return frame.withColumns({n: (F.floor(F.col(c) / side) + shift.get(n, F.lit(0))).cast("long") for n, c in zip("ijk", "xyz", strict=True)})

    lower = cells(placed.withColumn("at", F.explode(F.sequence("level", F.lit(top)))), {})
    around = F.explode(F.array(*(F.struct(*(F.lit(s).alias(n) for n, s in zip("abc", shift, strict=True))) for shift in itertools.product((-1, 0, 1), repeat=3)))).alias("s")
    upper = cells(placed.select("*", F.col("level").alias("at"), around), dict(zip("ijk", (F.col("s.a"), F.col("s.b"), F.col("s.c")), strict=True)))
    upper = upper.select(*keys, *(F.col(n).alias(f"{n}2") for n in ("block", "x", "y", "z", "r", "level")))
    apart = F.sqrt(sum((F.pow(F.col(n) - F.col(f"{n}2"), F.lit(2)) for n in "xyz"), F.lit(0e0))) - F.col("r") - F.col("r2")
    met = lower.join(upper, keys).where(apart <= F.lit(reach))
    # of one level both orders are there; of two the pair is turned round
    turned = F.explode(F.when(F.col("level") < F.col("level2"), F.array(F.struct("block", "block2"), F.struct(F.col("block2").alias("block"), F.col("block").alias("block2")))).otherwise(F.array(F.struct("block", "block2")))).alias("p")
    return met.select("project", "line", turned).select("project", "line", "p.*")


def line_stats(filtered: DataFrame, value: str = "g", name: str = "filtered") -> DataFrame:
    """Per project and line: points, missing values before and after, mean, std (ddof 0) and largest of |difference|."""
    d = F.col(value) - F.col(name)
    return filtered.where("project IS NOT NULL AND line IS NOT NULL").groupBy("project", "line").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(value).isNull()).alias("missing_in"),
        F.count_if(F.col(name).isNull()).alias("missing_out"),
        F.avg(F.abs(d)).alias("mean_abs"),
        F.stddev_pop(d).alias("std"),
        F.max(F.abs(d)).alias("max_abs"),
    )


def lines_per_project(obs: DataFrame) -> DataFrame:
    """Lines of each project (a missing name has a label), most first."""
    lines = obs.select(F.coalesce("project", F.lit(NO_PROJECT)).alias("project"), "line").distinct()
    return lines.groupBy("project").agg(F.count("*").alias("n_lines")).orderBy(F.desc("n_lines"), "project")


def project_count(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count_distinct("project").alias("n_projects"))


def report_pages(lines: DataFrame, rows_per_page: int = 22) -> DataFrame:
    """Line rows in pages of a report; numbered within each project."""
    order = Window.partitionBy("project").orderBy("line")
    return lines.withColumn("page", F.ceil(F.row_number().over(order) / rows_per_page))


_LINE = ["project", "line"]


class Ordered:
    """Points of lines in their order, with windows that long lines can bear.

    Short lines are one window each. Where a line has more than `WINDOW_LINE` points, all rows are dealt by ranges of (project,
    line, seq, obs_id): a range's part of a line is a window of its own, and what goes on beyond it (the point before, sums so
    far) is carried from a table with a row for each line and range.
    """

    def __init__(self, points: DataFrame) -> None:
        longest = points.groupBy(*_LINE).count().agg(F.max("count")).first()[0] or 0
        self.keys = _LINE
        if longest > WINDOW_LINE:
            self.keys = [*_LINE, "__range"]
            points = settle(points.repartitionByRange(*_LINE, "seq", "obs_id").withColumn("__range", F.spark_partition_id()))
        self.points = points
        self.order = Window.partitionBy(*self.keys).orderBy("seq", "obs_id")
        self.blocks = Window.partitionBy(*_LINE).orderBy("__range")  # a row for each range that holds a part of the line

    @property
    def parted(self) -> bool:
        return len(self.keys) > len(_LINE)

    def beside(self, points: DataFrame, step: int, **columns: Column) -> DataFrame:
        """The points with columns of the point before (step -1) or after (1), NULL at a line's ends."""
        move, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
        out = points.withColumns({n: move(c).over(self.order) for n, c in columns.items()})
        if not self.parted:
            return out
        # the edge row of each range, handed on to the next one
        out = out.withColumn("__edge", move(F.lit(1)).over(self.order).isNull())
        edges = points.groupBy(*self.keys).agg(edge(F.struct(*(c.alias(n) for n, c in columns.items())), F.struct("seq", "obs_id")).alias("__e"))
        edges = edges.select(*self.keys, move("__e").over(self.blocks).alias("__e"))
        out = out.join(edges, self.keys, "left")
        return out.withColumns({n: F.when(F.col("__edge"), F.col(f"__e.{n}")).otherwise(F.col(n)) for n in columns}).drop("__edge", "__e")

    def running(self, points: DataFrame, name: str, value: Column) -> DataFrame:
        """The points with the sum of a value up to each."""
        out = points.withColumn(name, F.sum(value).over(self.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if not self.parted:
            return out
        totals = points.groupBy(*self.keys).agg(F.sum(value).alias("__t"))
        before = totals.select(*self.keys, F.coalesce(F.sum("__t").over(self.blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
        return out.join(before, self.keys).withColumn(name, F.col(name) + F.col("__b")).drop("__b")


def _stepped(obs: DataFrame) -> tuple[Ordered, DataFrame]:
    ordered = Ordered(obs.dropna(subset=["lat", "lon"]).where("project IS NOT NULL AND line IS NOT NULL"))
    moved = ordered.beside(ordered.points, -1, __lat=F.col("lat"), __lon=F.col("lon"))
    stepped = moved.withColumn("step", haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))).drop("__lat", "__lon")
    return ordered, ordered.running(stepped, "along", F.coalesce("step", F.lit(0e0)))


def line_distances(obs: DataFrame) -> DataFrame:
    """Distance (m) to the previous point of the line in file order, and along the line from its first point."""
    return _stepped(obs)[1].drop("__range")


def distance_subsample(obs: DataFrame, spacing: float) -> DataFrame:
    """Points of each line nearest to the targets 0, s, 2s ...; a pick never repeats or goes back.

    The sequential rule (a nearest point at or before the last pick gives way to the one after the last pick) is
    pick(k) = max(nearest(k), pick(k-1) + 1). So pick(k) - k is the running maximum of nearest(k) - k: no loop.
    Each point knows the targets nearest to it from the midpoints to its neighbours; ties go to the earlier point.
    """
    ordered, placed = _stepped(obs)
    placed = ordered.running(placed, "i", F.lit(1)).withColumn("i", F.col("i") - 1)
    if ordered.parted:
        placed = settle(placed)
    whole = placed.groupBy(*_LINE).agg(F.count("*").alias("n"), F.max("along").alias("total"))
    spaced = F.lit(float(spacing))
    last = F.ceil((F.col("total") + spaced) / spaced) - 1
    firsts = ordered.beside(placed, -1, earlier=F.col("along")).where(F.coalesce(F.col("earlier") < F.col("along"), F.lit(True)))  # of points at one place the first counts
    if ordered.parted:
        firsts = settle(firsts)
    ends = ordered.beside(firsts, 1, later=F.col("along")).join(whole, _LINE)
    low = F.when(F.col("earlier").isNull(), F.lit(0).cast("long")).otherwise(F.floor((F.col("earlier") + F.col("along")) / 2e0 / spaced) + 1)
    high = F.when(F.col("later").isNull(), last).otherwise(F.least(F.floor((F.col("along") + F.col("later")) / 2e0 / spaced), last))
    ranged = ends.select(*_LINE, "i", "n", low.alias("low"), high.alias("high"))
    targets = ranged.where("low <= high").select(*_LINE, "i", "n", F.explode(F.sequence("low", "high")).alias("k")).withColumn("block", F.floor(F.col("k") / TARGET_BLOCK))
    blocks = targets.groupBy(*_LINE, "block").agg(F.max(F.col("i") - F.col("k")).alias("most"))
    carried = blocks.select(*_LINE, "block", F.max("most").over(Window.partitionBy(*_LINE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("most"))
    inside = Window.partitionBy(*_LINE, "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    picked = targets.withColumn("own", F.max(F.col("i") - F.col("k")).over(inside)).join(carried, [*_LINE, "block"])
    picks = picked.withColumn("i", F.col("k") + F.greatest("own", "most")).where("i < n").select(*_LINE, "i")
    return placed.join(picks, [*_LINE, "i"]).drop("i", "__range")


def sampling_report(obs: DataFrame, spacing: float) -> DataFrame:
    """Per project: mean spacing of the points and targets per 100 points."""
    lines = line_distances(obs).groupBy("project", "line").agg(F.sum("step").alias("length"), F.count("step").alias("steps"), F.count("*").alias("points"), F.max("along").alias("total"))
    lines = lines.withColumn("targets", F.ceil((F.col("total") + spacing) / spacing))
    sums = lines.groupBy("project").agg(*(F.sum(c).alias(c) for c in ("length", "steps", "points", "targets")))
    mean = F.when(F.col("steps") > 0, F.col("length") / F.col("steps")).otherwise(F.lit(0e0))
    return sums.select("project", mean.alias("mean_spacing"), (F.col("targets") / F.col("points") * 100e0).alias("per_hundred"))
