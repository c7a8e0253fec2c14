"""Registered queries over the test tables and their twins in DuckDB SQL.

Floats are rounded to about nine significant digits on both sides: the engines differ in the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.constants import PROBE_SEED
from plumbline.functions import gravity as G
from plumbline.functions import spherical as S
from plumbline.functions import text as X
from plumbline.operators import blocks, design, estimation, grids, harmonics, lines, outliers, quality_control, restore, stats
from plumbline.plans.views import view, with_views
from plumbline.session import checkpoint_folder, settle
from plumbline.sources import sinks, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


SIN2 = "pow(sin(radians(lat)), 2e0)"
COS2 = "pow(cos(radians(lat)), 2e0)"
GAMMA0 = f"((6378137e0 * 978032.67715e0 * {COS2} + 6356752.3141e0 * 983218.63685e0 * {SIN2}) / sqrt(6378137e0 * 6378137e0 * {COS2} + 6356752.3141e0 * 6356752.3141e0 * {SIN2}))"


def _gamma(h: str) -> str:
    return f"({GAMMA0} * (1e0 - 2e0 / 6378137e0 * (1e0 + 0.00335281068118e0 + 0.00344978600308e0 - 2e0 * 0.00335281068118e0 * {SIN2}) * ({h}) + 3e0 * ({h}) * ({h}) / (6378137e0 * 6378137e0)))"


GAMMA_H = _gamma("h")
_HAV = "pow(sin(radians({lat2} - {lat1}) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2e0)"
HAVERSINE = f"2e0 * 6378137e0 * asin(sqrt(CASE WHEN {_HAV} > 1 THEN 1e0 ELSE {_HAV} END))"


# ------------------------------------------------------------------------------------------------- scalars


@_query(f"SELECT obs_id, round({GAMMA0}, 3) AS gamma_0, round({GAMMA_H}, 3) AS gamma_h FROM obs_ter", "obs_ter")
def normal_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs_ter")
    return obs.select("obs_id", _r(G.normal_gravity(F.col("lat")), 3).alias("gamma_0"), _r(G.gravity_at_height(F.col("lat"), F.col("h")), 3).alias("gamma_h"))


def _disturbed(obs: DataFrame) -> DataFrame:
    return obs.withColumn("disturbance", G.disturbance(F.col("g"), F.col("lat"), F.col("h")))


@_query(f"SELECT obs_id, round(g - {GAMMA_H}, 6) AS disturbance FROM obs_ter", "obs_ter")
def gravity_disturbance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disturbed(view(spark, sf_dir, "obs_ter")).select("obs_id", _r("disturbance").alias("disturbance"))


@_query(f"SELECT obs_id, round(g - {_gamma('CASE WHEN obs_id % 3 = 1 THEN h + 12e0 ELSE h END')}, 6) AS disturbance FROM obs_ter", "obs_ter")
def disturbance_by_height_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs_ter")
    return obs.select("obs_id", _r(G.disturbance_by_height_type(F.col("g"), F.col("lat"), F.col("h"), F.lit(12e0), F.col("obs_id") % 3)).alias("disturbance"))


@_query("SELECT obs_id, round(0.874e0 - 9.9e-5 * h + 3.56e-9 * h * h, 6) AS correction FROM obs_ter", "obs_ter")
def atmospheric_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "obs_ter").select("obs_id", _r(G.atmospheric_correction(F.col("h"))).alias("correction"))


@_query("SELECT obs_id, CASE WHEN abs(d) <= 2 THEN 1e0 WHEN abs(d) > 2 THEN 0e0 END AS height_type FROM (SELECT obs_id, CASE WHEN obs_id % 11 = 0 THEN NULL ELSE (h - 2e3) / 1e2 END AS d FROM obs_ter)", "obs_ter")
def height_type_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("obs_id") % 11 == 0, F.lit(None)).otherwise((F.col("h") - 2e3) / 1e2)
    return view(spark, sf_dir, "obs_ter").select("obs_id", G.height_type(d).alias("height_type"))


@_query(
    "SELECT obs_id, round(degrees(atan(pow(6356752.314140356e0 / 6378137e0, 2e0) * tan(radians(lat)))), 9) AS geocentric, round(6378137e0 * 6356752.314140356e0 / sqrt(pow(6378137e0 * sin(radians(lat)), 2e0) + pow(6356752.314140356e0 * cos(radians(lat)), 2e0)) + h, 3) AS radius, "
    "CASE WHEN lon + 360e0 > 180 THEN lon + 360e0 - 360e0 ELSE lon + 360e0 END AS wrapped FROM obs_ter",
    "obs_ter",
)
def spherical_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.col("lat")
    return view(spark, sf_dir, "obs_ter").select("obs_id", _r(S.geocentric_latitude(lat), 9).alias("geocentric"), _r(S.observation_radius(lat, F.col("h")), 3).alias("radius"), S.wrap_longitude(F.col("lon") + 360e0).alias("wrapped"))


_TM = S.transverse_mercator_sql("lat", "lon")


@_query(f"SELECT obs_id, round({_TM[0]}, 2) AS east, round({_TM[1]}, 2) AS north FROM obs_ter", "obs_ter")
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_projection(view(spark, sf_dir, "obs_ter"), "east", "north").select("obs_id", _r("east", 2).alias("east"), _r("north", 2).alias("north"))


@_query(
    r"""SELECT p_partkey, translate(trim(p_name || '/' || p_type || ' :x'), '/\:*?"<>| ', '__________') AS file_name, lower(trim(p_brand)) IN ('1', 'true', 'yes', 'si', 'sí', 'on') AS is_true,
starts_with(p_type, substr(p_type, 1, 3)) OR starts_with(substr(p_type, 1, 3), p_type) AS matches FROM part"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.session import table

    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("/"), "p_type", F.lit(" :x"))
    return part.select("p_partkey", X.safe_filename(name).alias("file_name"), X.is_true(F.col("p_brand")).alias("is_true"), X.prefix_match(F.col("p_type"), F.substring("p_type", 1, 3)).alias("matches"))


# ------------------------------------------------------------------------------------------------- removal


_JOINED = f"SELECT o.obs_id, o.lat, o.lon, g - {GAMMA_H.replace('lat', 'o.lat')} AS d, ggm, topo_high - topo_low AS topo, ertm FROM obs_ter o LEFT JOIN model_signal m ON o.obs_id = m.obs_id"


def _with_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = view(spark, sf_dir, "model_signal")
    tables = {n: signal.select("obs_id", F.col(n).alias("value")) for n in ("ggm", "topo_high", "topo_low", "ertm")}
    return restore.attach(_disturbed(view(spark, sf_dir, "obs_ter")), "obs_id", **tables)


@_query(f"SELECT obs_id, round(d - ggm, 6) AS less_ggm, round(d - ggm - topo, 6) AS residual FROM ({_JOINED})", "obs_ter", "model_signal")
def residual_airborne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.remove_airborne(_with_signal(spark, sf_dir)).select("obs_id", _r("less_ggm").alias("less_ggm"), _r("residual").alias("residual"))


@_query(f"SELECT obs_id, round(topo, 6) AS topo, round(d - ggm - topo - ertm, 6) AS residual FROM ({_JOINED})", "obs_ter", "model_signal")
def residual_terrestrial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.remove_terrestrial(_with_signal(spark, sf_dir)).select("obs_id", _r("topo").alias("topo"), _r("residual").alias("residual"))


# ------------------------------------------------------------------------------------------------- lines


HALF_WIDTH_KM = 3.0
_B = repr(S.gaussian_b(HALF_WIDTH_KM))
_FILTERED = f"""WITH p AS (SELECT obs_id, project, line, g - {GAMMA_H} AS v, radians(lat) AS f, radians(lon) AS l FROM obs_air),
w AS (SELECT a.obs_id, b.v, exp(-{_B} * (1e0 - greatest(-1e0, least(1e0, sin(a.f) * sin(b.f) + cos(a.f) * cos(b.f) * cos(a.l - b.l))))) AS w FROM p a JOIN p b ON a.project = b.project AND a.line = b.line),
m AS (SELECT obs_id, sum(w * v) / sum(w) AS filtered FROM w GROUP BY obs_id)"""


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.gaussian_filter(_disturbed(view(spark, sf_dir, "obs_air")), HALF_WIDTH_KM, "disturbance")


@_query(f"{_FILTERED} SELECT obs_id, round(filtered, 6) AS filtered FROM m", "obs_air")
def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir).select("obs_id", _r("filtered").alias("filtered"))


@_query(
    f"{_FILTERED} SELECT project, line, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS missing_in, count(*) FILTER (WHERE filtered IS NULL) AS missing_out, round(avg(abs(v - filtered)), 6) AS mean_abs, round(stddev_pop(v - filtered), 6) AS std, round(max(abs(v - filtered)), 6) AS max_abs FROM p LEFT JOIN m ON p.obs_id = m.obs_id GROUP BY project, line",
    "obs_air",
)
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_stats(_filtered(spark, sf_dir), "disturbance")
    return found.select("project", "line", "n", "missing_in", "missing_out", *(_r(c).alias(c) for c in ("mean_abs", "std", "max_abs")))


@_query("SELECT coalesce(project, '(sin proyecto)') AS project, count(DISTINCT line) AS n_lines FROM obs_air GROUP BY 1", "obs_air")
def lines_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_per_project(view(spark, sf_dir, "obs_air"))


@_query("SELECT count(DISTINCT project) AS n_projects FROM obs_air", "obs_air")
def project_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.project_count(view(spark, sf_dir, "obs_air"))


@_query(
    "SELECT project, line, CAST(ceil(row_number() OVER (PARTITION BY project ORDER BY line) / 22e0) AS BIGINT) AS page FROM (SELECT DISTINCT project, line FROM obs_air)",
    "obs_air",
)
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report_pages(view(spark, sf_dir, "obs_air").select("project", "line").distinct()).select("project", "line", F.col("page").cast("long").alias("page"))


_STEP = HAVERSINE.format(lat1="lag(lat) OVER w", lon1="lag(lon) OVER w", lat2="lat", lon2="lon")
_ALONG = f"""WITH s AS (SELECT *, {_STEP} AS step FROM obs_air WINDOW w AS (PARTITION BY project, line ORDER BY seq, obs_id)),
a AS (SELECT *, sum(coalesce(step, 0e0)) OVER (PARTITION BY project, line ORDER BY seq, obs_id ROWS UNBOUNDED PRECEDING) AS along FROM s)"""


@_query(f"{_ALONG} SELECT obs_id, round(step, 3) AS step, round(along, 3) AS along FROM a", "obs_air")
def line_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_distances(view(spark, sf_dir, "obs_air")).select("obs_id", _r("step", 3).alias("step"), _r("along", 3).alias("along"))


SPACING = 2500.0


@_query(
    f"{_ALONG}, l AS (SELECT project, line, sum(step) AS length, count(step) AS steps, count(*) AS points, ceil((max(along) + 25e2) / 25e2) AS targets FROM a GROUP BY project, line) SELECT project, round(CASE WHEN sum(steps) > 0 THEN sum(length) / sum(steps) ELSE 0e0 END, 3) AS mean_spacing, round(sum(targets) / sum(points) * 1e2, 6) AS per_hundred FROM l GROUP BY project",
    "obs_air",
)
def sampling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.sampling_report(view(spark, sf_dir, "obs_air"), SPACING).select("project", _r("mean_spacing", 3).alias("mean_spacing"), _r("per_hundred").alias("per_hundred"))


@_query(
    f"""{_ALONG.replace("WITH s", "WITH RECURSIVE s", 1)}, i AS (SELECT *, row_number() OVER (PARTITION BY project, line ORDER BY seq, obs_id) - 1 AS i, count(*) OVER (PARTITION BY project, line) AS n, max(along) OVER (PARTITION BY project, line) AS total FROM a),
t AS (SELECT DISTINCT project, line, n, unnest(range(CAST(ceil((total + 25e2) / 25e2) AS BIGINT))) AS k FROM i),
q AS (SELECT t.project, t.line, t.n, t.k, arg_min(i.i, struct_pack(d := abs(i.along - t.k * 25e2), i := i.i)) AS near FROM t JOIN i ON t.project = i.project AND t.line = i.line GROUP BY ALL),
z AS (SELECT project, line, n, k, near AS pick FROM q WHERE k = 0 UNION ALL SELECT q.project, q.line, q.n, q.k, greatest(q.near, z.pick + 1) FROM z JOIN q ON q.project = z.project AND q.line = z.line AND q.k = z.k + 1)
SELECT i.obs_id, i.project, i.line FROM z JOIN i ON i.project = z.project AND i.line = z.line AND i.i = z.pick WHERE z.pick < z.n""",
    "obs_air",
)
def distance_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.distance_subsample(view(spark, sf_dir, "obs_air"), SPACING).select("obs_id", "project", "line")


# ------------------------------------------------------------------------------------------------- statistics


_DIST = f"(SELECT obs_id, project, g - {GAMMA_H} AS d, h, lat, lon FROM obs_ter)"


@_query(f"SELECT project, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, count(d) AS n FROM {_DIST} GROUP BY project", "obs_ter")
def project_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_control.project_bias(_disturbed(view(spark, sf_dir, "obs_ter")), "disturbance").select("project", _r("mean").alias("mean"), _r("std").alias("std"), "n")


@_query(f"SELECT arg_min(project, struct_pack(a := abs(m), p := project)) AS project, round(min(abs(m)), 6) AS abs_mean FROM (SELECT project, avg(d) AS m FROM {_DIST} GROUP BY project)", "obs_ter")
def reference_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_control.reference_project(_disturbed(view(spark, sf_dir, "obs_ter")), "disturbance").select("project", _r("abs_mean").alias("abs_mean"))


@_query(f"SELECT project, round(avg(d - ggm - topo), 6) AS mean, row_number() OVER (ORDER BY abs(avg(d - ggm - topo)), project) AS rank FROM (SELECT j.*, project FROM ({_JOINED}) j JOIN obs_ter t ON j.obs_id = t.obs_id) GROUP BY project", "obs_ter", "model_signal")
def satop_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = restore.remove_airborne(_with_signal(spark, sf_dir))
    return quality_control.satop_ranking(points).select("project", _r("mean").alias("mean"), F.col("rank").cast("long").alias("rank"))


@_query(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(max({c}), 6) AS max, round(min({c}), 6) AS min, round(median({c}), 6) AS median FROM (SELECT d AS disturbance, h FROM {_DIST})" for c in ("disturbance", "h")),
    "obs_ter",
)
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.column_stats(_disturbed(view(spark, sf_dir, "obs_ter")), ["disturbance", "h"])
    return found.select("column", "n", *(_r(c).alias(c) for c in ("mean", "std", "max", "min", "median")))


@_query(f"SELECT round(quantile_cont(abs(d), 0.99), 6) AS p99, round(median(d), 6) AS median FROM {_DIST}", "obs_ter")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _disturbed(view(spark, sf_dir, "obs_ter"))
    (p99,), (median,) = stats.exact_quantiles(obs, F.abs("disturbance"), [0.99]), stats.exact_quantiles(obs, F.col("disturbance"), [0.5])
    return spark.range(1).select(_r(F.lit(p99)).alias("p99"), _r(F.lit(median)).alias("median"))


def _histogram_sql(bins: int, density: bool) -> str:
    value = ", round(coalesce(k, 0) / (total * (hi - lo) / {0}e0), 9) AS density".format(bins) if density else ""
    return f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM part_values), c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * {bins}e0), {bins - 1}) AS INT) AS bin, count(*) AS k FROM part_values, b GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, coalesce(k, 0) AS n{value} FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin"""


def _histogram(spark: SparkSession, sf_dir: str, bins: int, density: bool) -> DataFrame:
    found = stats.histogram(view(spark, sf_dir, "grid"), F.col("value"), bins, density)
    return found.select("bin", "n", *([_r("density", 9).alias("density")] if density else []))


@_query(_histogram_sql(20, True).replace("part_values", "grid"), "grid")
def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, 20, True)


@_query(_histogram_sql(60, False).replace("part_values", "grid"), "grid")
def histogram60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir, 60, False)


@_query(
    """WITH m AS (SELECT avg(g - 9795e2) AS mean, stddev_samp(g - 9795e2) AS std, min(g - 9795e2) AS low, max(g - 9795e2) AS high FROM obs_ter)
SELECT CAST(i AS BIGINT) AS i, round(low + i * (high - low) / 999e0, 6) AS x, round(exp(-pow((low + i * (high - low) / 999e0 - mean) / std, 2e0) / 2e0) / (std * sqrt(2e0 * pi())), 9) AS density FROM m, (SELECT unnest(range(1000)) AS i)""",
    "obs_ter",
)
def normal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve over the histogram of the table's values."""
    v = F.col("g") - 9795e2
    mean, std, low, high = view(spark, sf_dir, "obs_ter").agg(F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)).first()
    place = F.round((F.col("x") - F.lit(low)) / F.lit((high - low) / 999)).cast("long")
    return stats.normal_curve(spark, mean, std, low, high).select(place.alias("i"), _r("x").alias("x"), _r("density", 9).alias("density"))


@_query("SELECT round(min(lon) - 0.3e0, 9) AS west, round(max(lon) + 0.3e0, 9) AS east, round(min(lat) - 0.3e0, 9) AS south, round(max(lat) + 0.3e0, 9) AS north FROM obs_ter", "obs_ter")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extent(view(spark, sf_dir, "obs_ter")).select(*(_r(c, 9).alias(c) for c in ("west", "east", "south", "north")))


@_query("SELECT CASE WHEN min(value) = max(value) THEN min(value) - 1e-6 ELSE min(value) END AS low, CASE WHEN min(value) = max(value) THEN max(value) + 1e-6 ELSE max(value) END AS high FROM grid WHERE isfinite(value)", "grid")
def finite_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.finite_range(view(spark, sf_dir, "grid"), "value")


@_query("SELECT r, c, round(least(value, (SELECT quantile_cont(value, 0.95) FROM grid)), 6) AS clipped FROM grid", "grid")
def clip_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.clip_p95(view(spark, sf_dir, "grid"), "value", "clipped").select("r", "c", _r("clipped").alias("clipped"))


@_query("SELECT obs_id, round(least(greatest(d, -4e1), 4e1), 6) AS clipped FROM (SELECT obs_id, g - 9795e2 AS d FROM obs_ter)", "obs_ter")
def clip_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "obs_ter").select("obs_id", _r(stats.clip(F.col("g") - 9795e2, -40, 40)).alias("clipped"))


@_query(
    "WITH c AS (SELECT obs_id, h, g - 9795e2 AS d, CASE WHEN h >= 2e3 THEN 'high' WHEN h < 2e3 THEN 'low' END AS height_class FROM obs_ter), b AS (SELECT height_class, avg(d) + 3e0 * stddev_samp(d) AS bound FROM c GROUP BY 1) SELECT obs_id, c.height_class, CASE WHEN d > -bound AND d < bound THEN true WHEN d < -bound OR d > bound THEN false END AS kept FROM c JOIN b ON c.height_class = b.height_class",
    "obs_ter",
)
def three_sigma_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs_ter").withColumn("difference", F.col("g") - 9795e2)
    return quality_control.three_sigma_by_height(obs).select("obs_id", "height_class", "kept")


# ------------------------------------------------------------------------------------------------- outliers


_V = "SELECT obs_id, lat, lon, CASE WHEN obs_id % 17 = 3 THEN (g - 9795e2) * 9e0 ELSE (g - 9795e2) END AS v"


def _spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrestrial points of which some are far off."""
    v = F.col("g") - 9795e2
    return view(spark, sf_dir, "obs_ter").select("obs_id", "lat", "lon", F.when(F.col("obs_id") % 17 == 3, v * 9e0).otherwise(v).alias("value"))


_CANDIDATES = f"""WITH p AS ({_V} FROM obs_ter), m AS (SELECT median(v) AS med FROM p), n AS (SELECT med, 1.4826e0 * median(abs(v - med)) AS nmad FROM p, m GROUP BY med),
c AS (SELECT p.* FROM p, n WHERE v > med + 3e0 * nmad OR v < med - 3e0 * nmad)"""


@_query(f"{_CANDIDATES} SELECT obs_id, round(v, 6) AS value FROM c", "obs_ter")
def nmad_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.nmad_candidates(_spiked(spark, sf_dir)).select("obs_id", _r("value").alias("value"))


_NEAR = f"""{_CANDIDATES}, x AS (SELECT obs_id, v, {_TM[0]} AS x, {_TM[1]} AS y, obs_id IN (SELECT obs_id FROM c) AS cand FROM p),
d AS (SELECT a.obs_id AS cand, a.v AS cv, b.obs_id AS ref, b.v, sqrt(pow(a.x - b.x, 2e0) + pow(a.y - b.y, 2e0)) AS dist FROM x a JOIN x b ON a.cand AND NOT b.cand AND sqrt(pow(a.x - b.x, 2e0) + pow(a.y - b.y, 2e0)) <= 1e5)"""
_INTERP = f"{_NEAR}, i AS (SELECT cand, sum(v / dist) / sum(1e0 / dist) AS interp, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY dist, ref) AS k FROM d) WHERE k <= 2800 GROUP BY cand)"


@_query(f"{_INTERP} SELECT cand AS obs_id, round(interp, 6) AS interp FROM i", "obs_ter")
def idw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = settle(S.with_projection(_spiked(spark, sf_dir)).select("obs_id", "value", "x", "y"))
    candidates = outliers.nmad_candidates(points)
    found = outliers.nearest_means(candidates, points.join(candidates.select("obs_id"), "obs_id", "left_anti"), 1e5)
    return found.select(F.col("cand").alias("obs_id"), _r("interp").alias("interp"))


@_query(
    f"""{_INTERP}, l AS (SELECT d.cand, 8e0 * 1.4826e0 * median(abs(v - med)) AS local FROM d JOIN (SELECT cand, median(v) AS med FROM d GROUP BY cand) q ON q.cand = d.cand GROUP BY d.cand),
e AS (SELECT quantile_cont(abs(v), 0.99) AS eps FROM p),
o AS (SELECT x.obs_id, x.v, coalesce(i.interp, x.v) AS interp, (abs(x.v - coalesce(i.interp, x.v)) > eps AND abs(x.v) > eps) OR coalesce(abs(x.v - coalesce(i.interp, x.v)) > local, false) AS out FROM x CROSS JOIN e LEFT JOIN i ON i.cand = x.obs_id LEFT JOIN l ON l.cand = x.obs_id),
m2 AS (SELECT median(v) AS med2 FROM o WHERE NOT out), n2 AS (SELECT med2, 1.4826e0 * median(abs(v - med2)) AS nmad2 FROM o, m2 WHERE NOT out GROUP BY med2)
SELECT obs_id, round(interp, 6) AS interp, round(abs(v - interp), 6) AS difference, out AS is_outlier, v > med2 + 3e0 * nmad2 OR v < med2 - 3e0 * nmad2 AS is_candidate FROM o, n2""",
    "obs_ter",
)
def spatial_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.detect(_spiked(spark, sf_dir)).select("obs_id", _r("interp").alias("interp"), _r("difference").alias("difference"), "is_outlier", "is_candidate")


# ------------------------------------------------------------------------------------------------- grids


def _region(spark: SparkSession, sf_dir: str) -> tuple[float, float, float, float]:
    """South, north, west and east of the terrestrial points in whole degrees."""
    r = view(spark, sf_dir, "obs_ter").agg(F.floor(F.min("lat")), F.ceil(F.max("lat")), F.floor(F.min("lon")), F.ceil(F.max("lon"))).first()
    return tuple(float(x) for x in r)


_REGION_SQL = "x AS (SELECT floor(min(lat)) AS south, ceil(max(lat)) AS north, floor(min(lon)) AS west, ceil(max(lon)) AS east FROM obs_ter)"
_CIRCLES_SQL = f"WITH {_REGION_SQL}, r AS (SELECT l, degrees(phi) AS lat, CAST(floor(2e0 * pi() / acos((cos(pi() / 181e0) - pow(sin(phi), 2e0)) / pow(cos(phi), 2e0))) AS BIGINT) AS k FROM (SELECT l, -pi() / 2e0 + l * pi() / 181e0 AS phi FROM (SELECT unnest(range(1, 181)) AS l)))"


@_query(f"{_CIRCLES_SQL} SELECT l, round(lat, 9) AS lat, CAST(k AS INT) AS count, (SELECT count(*) FROM obs_ter o WHERE CAST(round((o.lat + 9e1) * 181e0 / 18e1) AS BIGINT) = l) AS n_points FROM r, x WHERE lat BETWEEN south AND north", "obs_ter")
def reuter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of latitude across the points' region, and the points nearest to each."""
    south, north, _, _ = _region(spark, sf_dir)
    near = view(spark, sf_dir, "obs_ter").groupBy(F.round((F.col("lat") + 90e0) * 181e0 / 180e0).cast("long").alias("l")).agg(F.count("*").alias("n"))
    rows = grids.reuter_rows(spark, 180).where(F.col("lat").between(south, north)).join(near, "l", "left")
    return rows.select("l", _r("lat", 9).alias("lat"), "count", F.coalesce("n", F.lit(0)).cast("long").alias("n_points"))


@_query(
    f"""{_CIRCLES_SQL}, n AS (SELECT l, lat, m, CASE WHEN m * 36e1 / k > 180 THEN m * 36e1 / k - 36e1 ELSE m * 36e1 / k END AS lon FROM (SELECT *, unnest(range(k)) AS m FROM r))
SELECT l, CAST(m AS INT) AS m, round(lat, 9) AS lat, round(lon, 9) AS lon FROM n, x WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east""",
    "obs_ter",
)
def reuter_nodes_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in the points' region."""
    return grids.reuter_nodes(spark, 180, *_region(spark, sf_dir)).select("l", F.col("m").cast("int").alias("m"), _r("lat", 9).alias("lat"), _r("lon", 9).alias("lon"))


@_query(
    f"""WITH {_REGION_SQL}, d AS (SELECT *, CAST(round((north - south) / 25e-2) AS BIGINT) AS rows, CAST(round((east - west) / 25e-2) AS BIGINT) AS cols FROM x),
p AS (SELECT r * cols + c AS pixel_id, south + (r + 5e-1) * 25e-2 AS lat, west + (c + 5e-1) * 25e-2 AS lon FROM (SELECT *, unnest(range(cols)) AS c FROM (SELECT *, unnest(range(rows)) AS r FROM d))),
k AS (SELECT CAST(floor((lat - south) / 25e-2) * cols + floor((lon - west) / 25e-2) AS BIGINT) AS pixel_id, count(*) AS n FROM obs_ter, d GROUP BY 1)
SELECT CAST(p.pixel_id AS BIGINT) AS pixel_id, round(lat, 9) AS lat, round(lon, 9) AS lon, coalesce(n, 0) AS n_points FROM p LEFT JOIN k ON k.pixel_id = p.pixel_id""",
    "obs_ter",
)
def pixel_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the points' region, and how many points each holds."""
    south, north, west, east = _region(spark, sf_dir)
    cols = round((east - west) / 0.25)
    cell = (F.floor((F.col("lat") - south) / 0.25) * cols + F.floor((F.col("lon") - west) / 0.25)).cast("long")
    held = view(spark, sf_dir, "obs_ter").groupBy(cell.alias("pixel_id")).agg(F.count("*").alias("n"))
    pixels = grids.pixel_centres(spark, south, north, west, east, 0.25).join(held, "pixel_id", "left")
    return pixels.select("pixel_id", _r("lat", 9).alias("lat"), _r("lon", 9).alias("lon"), F.coalesce("n", F.lit(0)).cast("long").alias("n_points"))


@_query(
    f"WITH {_REGION_SQL} SELECT CAST(lat AS INT) AS lat, CAST(lon AS INT) AS lon, (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS name FROM (SELECT unnest(range(-90, 90, 5)) AS lat) CROSS JOIN (SELECT unnest(range(-180, 180, 5)) AS lon), x WHERE lat < north AND lat + 5 > south AND lon < east AND lon + 5 > west",
    "obs_ter",
)
def tile_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that the points' region meets."""
    return grids.tiles_in(spark, *_region(spark, sf_dir))


_BILINEAR = """WITH b AS (SELECT obs_id, (lat - 355e-1) / 25e-2 AS u, (lon + 1095e-1) / 25e-2 AS v FROM obs_ter),
f AS (SELECT obs_id, CAST(floor(u) AS INT) AS r, CAST(floor(v) AS INT) AS c, u - floor(u) AS fu, v - floor(v) AS fv FROM b),
s AS (SELECT f.obs_id, (1 - fu) * (1 - fv) * a.value + (1 - fu) * fv * b.value + fu * (1 - fv) * c.value + fu * fv * d.value AS sampled FROM f
JOIN grid a ON a.r = f.r AND a.c = f.c JOIN grid b ON b.r = f.r AND b.c = f.c + 1 JOIN grid c ON c.r = f.r + 1 AND c.c = f.c JOIN grid d ON d.r = f.r + 1 AND d.c = f.c + 1)"""


@_query(f"{_BILINEAR} SELECT obs_id, round(sampled, 6) AS sampled FROM s", "obs_ter", "grid")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "obs_ter")
    return grids.bilinear(points, view(spark, sf_dir, "grid"), "obs_id", 35.5, -109.5, 0.25).select("obs_id", _r("sampled").alias("sampled"))


@_query(f"{_BILINEAR} SELECT o.obs_id, round(coalesce(sampled, 0e0), 6) AS sampled FROM obs_ter o LEFT JOIN s ON s.obs_id = o.obs_id", "obs_ter", "grid")
def bilinear_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "obs_ter")
    return grids.bilinear(points, view(spark, sf_dir, "grid"), "obs_id", 35.5, -109.5, 0.25, "zero").select("obs_id", _r("sampled").alias("sampled"))


@_query("SELECT r, c, CAST(dense_rank() OVER (ORDER BY lat DESC) - 1 AS INT) AS row, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INT) AS col FROM grid", "grid")
def raster_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.raster_index(view(spark, sf_dir, "grid")).select("r", "c", "row", "col")


@_query("SELECT round_even(lat + 0e0, 10) AS lat, round_even(lon, 10) AS lon, round(avg(value), 6) AS value, count(*) AS n FROM (SELECT lat, lon, value FROM grid UNION ALL SELECT lat + 1e-13, lon, value + 2e0 FROM grid WHERE c < 5) GROUP BY 1, 2", "grid")
def raster_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = view(spark, sf_dir, "grid").select("lat", "lon", "value", "c")
    near = grid.where("c < 5").withColumn("lat", F.col("lat") + 1e-13).withColumn("value", F.col("value") + 2e0)
    return grids.raster_dedupe(grid.unionByName(near)).select("lat", "lon", _r("value").alias("value"), "n")


@_query("SELECT a.lat, b.lon, coalesce(value, 0e0) AS value FROM (SELECT DISTINCT lat FROM grid) a CROSS JOIN (SELECT DISTINCT lon FROM grid) b LEFT JOIN (SELECT * FROM grid WHERE (r + c) % 3 <> 0) g ON g.lat = a.lat AND g.lon = b.lon", "grid")
def full_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = view(spark, sf_dir, "grid")
    holes = grid.withColumn("value", F.when((F.col("r") + F.col("c")) % 3 != 0, F.col("value")))
    return grids.full_raster(holes)


@_query("SELECT obs_id, value AS sampled FROM obs_ter o LEFT JOIN grid g ON g.r = CAST(floor((o.lat - 355e-1) / 25e-2 + 5e-1) AS INT) AND g.c = CAST(floor((o.lon + 1095e-1) / 25e-2 + 5e-1) AS INT)", "obs_ter", "grid")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.nearest_cell(view(spark, sf_dir, "obs_ter"), view(spark, sf_dir, "grid"), "obs_id", 35.5, -109.5, 0.25).select("obs_id", "sampled")


@_query("SELECT round_even(lat, 10) AS lat, round_even(lon, 10) AS lon, round_even(value, 6) AS value FROM grid WHERE r % 2 = 0", "grid")
def raster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = view(spark, sf_dir, "grid").withColumn("value", F.when(F.col("r") % 2 == 0, F.col("value")).otherwise(F.lit(-99999e0)))
    return grids.raster_points(holes, -99999.0)


@_query("SELECT round((SELECT max(lat) - min(lat) FROM (SELECT DISTINCT lat FROM grid ORDER BY lat LIMIT 2)), 9) AS lat_step, round((SELECT max(lon) - min(lon) FROM (SELECT DISTINCT lon FROM grid ORDER BY lon LIMIT 2)), 9) AS lon_step", "grid")
def raster_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.raster_step(view(spark, sf_dir, "grid")).select(_r("lat_step", 9).alias("lat_step"), _r("lon_step", 9).alias("lon_step"))


@_query("SELECT lat, lon, value * 1e2 AS value FROM grid", "grid")
def raster_for_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.raster_for_maps(view(spark, sf_dir, "grid"), 100.0)


@_query("SELECT CAST(i AS BIGINT) AS ilat, CAST(j AS BIGINT) AS ilon, value FROM (SELECT unnest(range(10, 0, -1)) AS i) CROSS JOIN (SELECT unnest(range(5, 46)) AS j) LEFT JOIN grid ON r = i AND c = j", "grid")
def tile_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "grid").select(F.col("r").cast("long").alias("ilat"), F.col("c").cast("long").alias("ilon"), "value")
    return grids.mosaic(spark, cells, 1, 10, 5, 45, 1)


@_query("SELECT count(*) FILTER (WHERE v IS NULL) AS n_missing FROM (SELECT CASE WHEN c % 7 = 0 THEN NULL ELSE value END AS v FROM grid)", "grid")
def null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.null_count(view(spark, sf_dir, "grid").withColumn("value", F.when(F.col("c") % 7 != 0, F.col("value"))), "value")


@_query("SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n_clean, count(*) FILTER (WHERE o) AS n_outliers FROM (SELECT obs_id % 13 = 0 AS o, CASE WHEN obs_id % 13 <> 0 THEN g - 9795e2 END AS v FROM obs_ter)", "obs_ter")
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "obs_ter").withColumn("v", F.col("g") - 9795e2).withColumn("is_outlier", F.col("obs_id") % 13 == 0)
    return stats.clean_stats(points, "v").select(*(_r(c).alias(c) for c in ("min", "max", "mean", "std")), "n_clean", "n_outliers")


# ------------------------------------------------------------------------------------------------- model


N_MAX = 6
_LEGENDRE = "list_extract(p, {n})"


def _legendre_sql(x: str) -> list[str]:
    """P_0 to P_6 as polynomials."""
    return ["1e0", x, f"(3e0*pow({x},2e0)-1e0)/2e0", f"(5e0*pow({x},3e0)-3e0*{x})/2e0", f"(35e0*pow({x},4e0)-30e0*pow({x},2e0)+3e0)/8e0", f"(63e0*pow({x},5e0)-70e0*pow({x},3e0)+15e0*{x})/8e0", f"(231e0*pow({x},6e0)-315e0*pow({x},4e0)+105e0*pow({x},2e0)-5e0)/16e0"]


def _design_sql(potential: bool) -> str:
    a = "6378137e0"
    terms = " + ".join(f"({2 * n + 1}e0" + (f" * pow({a} / r, {n + 1}e0)" if potential else f" * {n + 1}e0 * pow({a} / r, {n + 1}e0) / r") + f" * ({p}))" for n, p in enumerate(_legendre_sql("t")))
    q = "atan(pow(6356752.314140356e0 / 6378137e0, 2e0) * tan(radians({0})))"
    po, pn = q.format("o.lat"), q.format("n.lat")
    return f"""WITH g AS (SELECT o.obs_id, n.node_id, n.beta, o.g, 6378137e0 * 6356752.314140356e0 / sqrt(pow(6378137e0 * sin(radians(o.lat)), 2e0) + pow(6356752.314140356e0 * cos(radians(o.lat)), 2e0)) + o.h AS r,
least(1e0, greatest(-1e0, sin({po}) * sin({pn}) + cos({po}) * cos({pn}) * cos(radians(o.lon - n.lon)))) AS t FROM obs_ter o CROSS JOIN nodes n),
d AS (SELECT obs_id, node_id, beta, g, ({terms}) / (4e0 * pi()) AS a FROM g)"""


def _basis(spark: SparkSession, sf_dir: str) -> design.Basis:
    return design.Basis.of(view(spark, sf_dir, "nodes"), N_MAX)


@_query(f"{_design_sql(False)} SELECT obs_id, node_id, round(a * 1e6, 6) AS a FROM d", "obs_ter", "nodes")
def design_lowdegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.design_matrix(view(spark, sf_dir, "obs_ter"), _basis(spark, sf_dir), scale=1e6, digits=6)


@_query(f"{_design_sql(True)} SELECT obs_id, node_id, round(a * 1e-2, 6) AS a FROM d", "obs_ter", "nodes")
def design_tabulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The potential's design from tables of the kernel."""
    return design.design_matrix(view(spark, sf_dir, "obs_ter"), _basis(spark, sf_dir), potential=True, tabulated=True, scale=1e-2, digits=6)


@_query(f"{_design_sql(False)} SELECT x.node_id AS i, y.node_id AS j, round(sum(x.a * y.a) * 1e9, 5) AS v FROM d x JOIN d y ON x.obs_id = y.obs_id GROUP BY 1, 2", "obs_ter", "nodes")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs_ter").withColumn("y", F.lit(0e0)).withColumn("group_id", F.lit("all"))
    basis = _basis(spark, sf_dir)
    if basis.expands:
        return design.gram_entries(obs, basis, 1e9, 5)
    side = max(1, -(-len(basis.node_id) // 4))  # sixteen blocks, of which ten are summed
    system = blocks.BlockSystems.of(obs, basis, block=side)
    return blocks.entries(system.blocks, basis, side).select("i", "j", _r(F.col("v") * 1e9, 5).alias("v"))


@_query(f"{_design_sql(False)} SELECT node_id AS i, round(sum(a * (g - 9795e2)) * 1e3, 5) AS v FROM d GROUP BY 1", "obs_ter", "nodes")
def normal_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs_ter").withColumn("y", F.col("g") - 9795e2)
    return design.right_side(obs, _basis(spark, sf_dir)).select("i", _r(F.col("v") * 1e3, 5).alias("v"))


@_query(f"{_design_sql(True)} SELECT obs_id, round(sum(a * beta) * 1e6, 4) AS potential FROM d GROUP BY 1", "obs_ter", "nodes")
def predict_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis, beta = design.Basis.carrying(view(spark, sf_dir, "nodes"), "beta", N_MAX)
    found = design.synthesise(view(spark, sf_dir, "obs_ter"), basis, beta, "obs_id")
    return found.select("obs_id", _r(F.col("potential") * 1e6, 4).alias("potential"))


def _falling(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A covariance that falls with the distance of the ids."""
    return np.where(i == j, 2.0, 1 / (1.0 + np.abs(i - j)))


@_query(
    f"{_design_sql(True)}, c AS (SELECT i.node_id AS i, j.node_id AS j, CASE WHEN i.node_id = j.node_id THEN 2e0 ELSE 1e0 / (1e0 + abs(i.node_id - j.node_id)) END AS c FROM nodes i CROSS JOIN nodes j) SELECT x.obs_id, round(sqrt(greatest(sum(x.a * c.c * y.a), 0e0)), 5) AS std_potential FROM d x JOIN d y ON x.obs_id = y.obs_id JOIN c ON c.i = x.node_id AND c.j = y.node_id GROUP BY 1",
    "obs_ter",
    "nodes",
)
def std_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = _basis(spark, sf_dir)
    found = design.synthesise(view(spark, sf_dir, "obs_ter"), basis, np.zeros(len(basis.node_id)), "obs_id", covariance=_falling)
    return found.select("obs_id", _r("std_potential", 5).alias("std_potential"))


# ------------------------------------------------------------------------------------------------- restore


def _zeta_sql() -> str:
    total = "(potential + model + topo)"
    z = f"{total} / ({GAMMA_H} / 1e5) + terrain"
    q = f"p AS (SELECT obs_id, lat, h, (g - 9795e2) / 1e1 AS potential, 3e2 + lat AS model, lon / 1e1 AS topo, lon / 1e3 AS terrain, CASE WHEN obs_id % 5 = 0 THEN 0e0 ELSE h - 2e1 END AS srtm FROM obs_ter), z0 AS (SELECT *, {z} AS zeta FROM p)"
    for k in range(6):
        q += f", z{k + 1} AS (SELECT * EXCLUDE (zeta), {total} / ({_gamma('h - zeta')} / 1e5) + terrain AS zeta FROM z{k})"
    return "WITH " + q


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "obs_ter").select("obs_id", "lat", F.col("h").alias("height"), ((F.col("g") - 9795e2) / 1e1).alias("potential"), (F.lit(3e2) + F.col("lat")).alias("model"), (F.col("lon") / 1e1).alias("topo"), (F.col("lon") / 1e3).alias("terrain"), F.when(F.col("obs_id") % 5 == 0, F.lit(0e0)).otherwise(F.col("h") - 2e1).alias("srtm"), F.lit(2e-1).alias("std_potential"))
    return restore.restore(points)


@_query(f"{_zeta_sql()} SELECT obs_id, round(zeta, 8) AS zeta FROM z6", "obs_ter")
def restore_zeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).select("obs_id", _r("zeta", 8).alias("zeta"))


_NORMAL = "CASE WHEN srtm = 0 THEN -zeta ELSE h - zeta END"


@_query(f"{_zeta_sql()} SELECT obs_id, round({_NORMAL}, 6) AS normal_height, round(2e-1 / ({_gamma(_NORMAL)} / 1e5), 10) AS std_zeta, round((62636853.4e0 - 62636860.850e0) / ({_gamma(_NORMAL)} / 1e5), 9) AS zeta_0, round(zeta - (62636853.4e0 - 62636860.850e0) / ({_gamma(_NORMAL)} / 1e5), 8) AS zeta_final FROM z6", "obs_ter")
def zero_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore.zero_degree(restore.uncertainty(_restored(spark, sf_dir)))
    return found.select("obs_id", _r("normal_height").alias("normal_height"), _r("std_zeta", 10).alias("std_zeta"), _r("zeta_0", 9).alias("zeta_0"), _r("zeta_final", 8).alias("zeta_final"))


# ------------------------------------------------------------------------------------------------- estimation


@_query(
    """WITH q AS (SELECT iter, ln(res_norm) AS x, ln(sol_norm) AS y FROM norm_history), w AS (SELECT iter, x, y, lag(x) OVER o AS x0, lag(y) OVER o AS y0, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM q WINDOW o AS (ORDER BY iter))
SELECT iter, round(CASE WHEN x0 IS NULL OR x2 IS NULL THEN 0e0 ELSE 2e0 * abs((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)) / (sqrt(pow(x - x0, 2e0) + pow(y - y0, 2e0)) * sqrt(pow(x2 - x, 2e0) + pow(y2 - y, 2e0)) * sqrt(pow(x2 - x0, 2e0) + pow(y2 - y0, 2e0))) END, 5) AS curvature FROM w""",
    "norm_history",
)
def lcurve_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimation.curvature_table(view(spark, sf_dir, "norm_history")).select("iter", _r("curvature", 5).alias("curvature"))


@_query("SELECT p.project, coalesce(sigma2, 1e0) AS sigma2 FROM (SELECT DISTINCT project FROM obs_air) p LEFT JOIN sigma_prior s ON s.project = p.project", "obs_air", "sigma_prior")
def sigma_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimation.prior_sigmas(view(spark, sf_dir, "obs_air"), view(spark, sf_dir, "sigma_prior"))


@_query("SELECT node_id, round(abs(beta) * 1e6 / sqrt(4e0 + node_id), 6) AS t, abs(beta) * 1e6 / sqrt(4e0 + node_id) > 1.28212 AS is_significant FROM nodes", "nodes")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = view(spark, sf_dir, "nodes").select("node_id", (F.col("beta") * 1e6).alias("beta"), (F.lit(4e0) + F.col("node_id")).alias("variance"))
    return estimation.significance(parameters, view(spark, sf_dir, "obs_ter").count()).select("node_id", _r("t").alias("t"), "is_significant")


def _estimated(spark: SparkSession, sf_dir: str) -> tuple[estimation.Systems, estimation.Components]:
    obs = view(spark, sf_dir, "obs_ter").withColumn("y", (F.col("g") - 9795e2) / 1e5)
    systems = estimation.systems_of(estimation.group_by_project(obs, True, "ter"), _basis(spark, sf_dir), n_probes=1)
    return systems, estimation.estimate_components(systems, sigma2_mu=1e10)


#: A basis of two nodes, whose systems have closed forms in SQL.
PAIR = ((0, 372e-1, -1079e-1), (1, 384e-1, -1044e-1))
VCE_STEPS = 4
_PAIR_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT {i} AS node_id, {lat!r}::DOUBLE AS lat, {lon!r}::DOUBLE AS lon, 0e0 AS beta" for i, lat, lon in PAIR) + ")"
_SUMS_SQL = f"""WITH {_PAIR_SQL}, {_design_sql(False)[5:]},
w AS (SELECT d.obs_id, max(CASE WHEN node_id = 0 THEN a END) AS a0, max(CASE WHEN node_id = 1 THEN a END) AS a1, any_value((d.g - 9795e2) / 1e5) AS y FROM d GROUP BY d.obs_id),
s AS (SELECT project, count(*) AS n, sum(a0 * a0) AS x00, sum(a0 * a1) AS x01, sum(a1 * a1) AS x11, sum(a0 * y) AS y0, sum(a1 * y) AS y1, sum(y * y) AS yy FROM w JOIN obs_ter USING (obs_id) GROUP BY project)"""
_UNSIGNED = 1 << 64


def _sign_sql(key: str) -> str:
    """The first random sign of a key, as `design.probes` has it: 64-bit products by their remainder."""
    x = f"CAST(CAST({key} + 1 AS UHUGEINT) * {0x9E3779B97F4A7C15} % {_UNSIGNED} AS UBIGINT)"
    x = f"xor({x}, CAST({PROBE_SEED * 0xBF58476D1CE4E5B9 % (1 << 64)} AS UBIGINT))"
    x = f"CAST(CAST(xor({x}, {x} >> 31) AS UHUGEINT) * {0x94D049BB133111EB} % {_UNSIGNED} AS UBIGINT)"
    return f"(CASE WHEN {x} >> 63 = 0 THEN 1e0 ELSE -1e0 END)"


_SIGNED_SQL = _SUMS_SQL.replace("sum(y * y) AS yy", f"sum(y * y) AS yy, sum(a0 * {_sign_sql('obs_id')}) AS u0, sum(a1 * {_sign_sql('obs_id')}) AS u1")
_SQUARES_SQL = "greatest(b0 * b0 * x00 + 2e0 * b0 * b1 * x01 + b1 * b1 * x11 - 2e0 * (b0 * y0 + b1 * y1) + yy, 0e0)"


def _digits_sql(x: str, digits: int = 5) -> str:
    """Decimal exponent and mantissa: numbers of any size compared to as many digits."""
    e = f"CAST(floor(log10(abs({x}))) AS INT)"
    return f"{e} AS exponent, round({x} / pow(1e1, {e}), {digits}) AS mantissa"


def _digits(frame: DataFrame, name: str, digits: int = 5) -> DataFrame:
    e = F.floor(F.log10(F.abs(name))).cast("int")
    return frame.withColumn("exponent", e).withColumn("mantissa", _r(F.col(name) / F.pow(F.lit(10e0), F.col("exponent")), digits)).drop(name)


def _vce_sql(textbook: bool, sampled: bool = False) -> str:
    """Components of all projects and the prior, step by step; sampled: the traces of a random sign for each observation."""
    q, out = (_SIGNED_SQL if sampled else _SUMS_SQL) + ", v0 AS (SELECT project, 1e0 AS s2, 1e10 AS mu FROM s)", []
    trace, prior = "(i00 * x00 + 2e0 * i01 * x01 + i11 * x11)", "(i00 + i11)"
    if sampled:
        own = [_sign_sql(f"CAST({10**9 + k} AS BIGINT)") for k in range(2)]
        trace, prior = "(i00 * u0 * u0 + 2e0 * i01 * u0 * u1 + i11 * u1 * u1)", f"(i00 + 2e0 * i01 * {own[0]} * {own[1]} + i11)"
    for k in range(VCE_STEPS):
        by = (" / v.s2", " / b.mu") if textbook else ("", "")
        q += f""", m{k} AS (SELECT sum(x00 / s2) + 1e0 / any_value(mu) AS n00, sum(x01 / s2) AS n01, sum(x11 / s2) + 1e0 / any_value(mu) AS n11, sum(y0 / s2) AS r0, sum(y1 / s2) AS r1, any_value(mu) AS mu FROM s JOIN v{k} USING (project)),
b{k} AS (SELECT mu, (n11 * r0 - n01 * r1) / det AS b0, (n00 * r1 - n01 * r0) / det AS b1, n11 / det AS i00, -n01 / det AS i01, n00 / det AS i11 FROM (SELECT *, n00 * n11 - n01 * n01 AS det FROM m{k})),
v{k + 1} AS (SELECT s.project, {_SQUARES_SQL} / (n - {trace}{by[0]}) AS s2, (b0 * b0 + b1 * b1) / (2e0 - {prior}{by[1]}) AS mu FROM s JOIN v{k} v USING (project), b{k} b)"""
        out.append(f"SELECT {k + 1} AS iter, project AS component, {_digits_sql('s2')} FROM v{k + 1}")
        out.append(f"SELECT DISTINCT {k + 1}, 'prior', {_digits_sql('mu')} FROM v{k + 1}")
    return q + " " + " UNION ALL ".join(out)


def _pair_systems(spark: SparkSession, sf_dir: str, n_probes: int = 0) -> dict[str, design.Normal]:
    i, lat, lon = (np.array(x) for x in zip(*PAIR, strict=True))
    obs = view(spark, sf_dir, "obs_ter").withColumn("y", (F.col("g") - 9795e2) / 1e5)
    return design.normal_systems(estimation.group_by_project(obs, True, "ter"), design.Basis(i, lat, lon, N_MAX), n_probes=n_probes)


def _steps(spark: SparkSession, systems: dict[str, design.Normal], **options: object) -> DataFrame:
    found = estimation.estimate_components(systems, sigma2_mu=1e10, max_iter=VCE_STEPS, tol=0.0, **options)
    rows = [(k, name, float(v)) for k, row in enumerate(found.history, 1) for name, v in zip([*systems, "prior"], row, strict=True)]
    return _digits(spark.createDataFrame(rows, "iter int, component string, sigma2 double"), "sigma2")


@_query(_vce_sql(False), "obs_ter")
def vce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all projects and the prior with exact traces, a basis of two nodes."""
    return _steps(spark, _pair_systems(spark, sf_dir))


@_query(_vce_sql(True), "obs_ter")
def vce_textbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with redundancies as textbooks have them."""
    return _steps(spark, _pair_systems(spark, sf_dir), textbook=True)


@_query(_vce_sql(False, True), "obs_ter")
def vce_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with traces sampled by one random sign for each observation and node."""
    return _steps(spark, _pair_systems(spark, sf_dir, 1))


@_query()
def vce_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all nodes and sampled traces, until it settles."""
    systems, found = _estimated(spark, sf_dir)
    rows = [(k, name, float(v)) for k, row in enumerate(found.history, 1) for name, v in zip([*systems.sums, "prior"], row, strict=True)]
    return spark.createDataFrame(rows, "iter int, component string, sigma2 double")


@_query(
    _SUMS_SQL + f""", r AS (SELECT *, 1e0 / (1e0 + 5e-1 * (row_number() OVER (ORDER BY project) - 1)) AS k FROM s),
m AS (SELECT sum(k * x00) AS m00, sum(k * x01) AS m01, sum(k * x11) AS m11, sum(k * y0) AS r0, sum(k * y1) AS r1 FROM r),
l AS (SELECT i, 1e-9 * pow(1e1, -4e0 + 8e0 * i / 19e0) AS lam FROM (SELECT unnest(range(20)) AS i)),
b AS (SELECT i, lam, ((m11 + lam) * r0 - m01 * r1) / det AS b0, ((m00 + lam) * r1 - m01 * r0) / det AS b1 FROM (SELECT *, (m00 + lam) * (m11 + lam) - m01 * m01 AS det FROM l, m)),
z AS (SELECT i, lam, sqrt(sum({_SQUARES_SQL})) AS res, any_value(sqrt(b0 * b0 + b1 * b1)) AS sol FROM b, s GROUP BY i, lam)
SELECT CAST(i AS INT) AS step, 'residual' AS norm, {_digits_sql("res")} FROM z UNION ALL SELECT CAST(i AS INT), 'solution', {_digits_sql("sol")} FROM z""",
    "obs_ter",
)
def lcurve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both norms of the coarse sweep for given variances, a basis of two nodes."""
    systems = _pair_systems(spark, sf_dir)
    given = np.array([[*(1 + 0.5 * k for k in range(len(systems))), 1.0]])
    found = estimation.Components(np.zeros(2), estimation.DenseFactor(np.eye(2)), {}, 1.0, given, np.ones((1, 2)), 1)
    coarse = estimation.l_curve(systems, found, 1e-9).coarse
    rows = [(k, name, float(v)) for k, row in enumerate(coarse) for name, v in zip(("residual", "solution"), row[1:], strict=True)]
    return _digits(spark.createDataFrame(rows, "step int, norm string, v double"), "v")


@_query()
def lcurve_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sweeps with all nodes and estimated variances."""
    systems, found = _estimated(spark, sf_dir)
    corner = estimation.l_curve(systems, found)
    rows = [(kind, float(a), float(b), float(c)) for kind, sweep in (("coarse", corner.coarse), ("fine", corner.fine)) for a, b, c in sweep]
    return spark.createDataFrame(rows, "sweep string, lambda double, res_norm double, sol_norm double")


@_query(
    """SELECT obs_id, round((1e0 + q * q * (1e-3 * sqrt(5e0) * (3e0 * t * t - 1e0) / 2e0 + sqrt(15e0) * t * u * (2e-4 * cos(l) - 3e-4 * sin(l)) + sqrt(15e0) / 2e0 * u * u * (5e-4 * sin(2e0 * l) - 1e-4 * cos(2e0 * l)))
  + q * q * q * sqrt(70e0) / 4e0 * u * u * u * (2e-4 * cos(3e0 * l) + 1e-4 * sin(3e0 * l))) * 3986004.415e8 / r / 1e3, 4) AS potential FROM
(SELECT obs_id, l, r, 6378136.3e0 / r AS q, z / r AS t, x / r AS u FROM (SELECT obs_id, l, x, z, sqrt(x * x + z * z) AS r FROM
(SELECT obs_id, l, (n + h) * cos(f) AS x, (n * (1e0 - e2) + h) * sin(f) AS z FROM (SELECT obs_id, h, radians(lon) AS l, radians(lat) AS f, 6378137e0 / sqrt(1e0 - e2 * pow(sin(radians(lat)), 2e0)) AS n, e2 FROM (SELECT *, 0.00335281068118e0 * (2e0 - 0.00335281068118e0) AS e2 FROM obs_ter)))))""",
    "obs_ter",
)
def sh_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spark.createDataFrame([(0, 0, 1.0, 0.0), (2, 0, 1e-3, 0.0), (2, 1, 2e-4, -3e-4), (2, 2, -1e-4, 5e-4), (3, 3, 2e-4, 1e-4)], "n int, m int, c double, s double")
    found = harmonics.synthesis(view(spark, sf_dir, "obs_ter"), model, 4, functional="potential")
    return found.select("obs_id", _r(F.col("value") / 1e3, 4).alias("potential"))


# ------------------------------------------------------------------------------------------------- files


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/round-trip-{uuid.uuid4().hex}"


@_query("SELECT obs_id, project, lat, lon, h, g FROM obs_ter", "obs_ter")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated with header, written and read back: text and numbers as they were."""
    folder = _scratch(spark)
    sinks.write_table(view(spark, sf_dir, "obs_ter"), folder)
    found = text.read_table(spark, folder, numbers=["lat", "lon", "h", "g"])
    return found.select(F.col("obs_id").cast("long").alias("obs_id"), "project", "lat", "lon", "h", "g")


@_query("SELECT lat, lon, h FROM obs_ter", "obs_ter")
def points_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without header, as synthesis tools read it, and read back by blanks."""
    folder = _scratch(spark)
    sinks.write_points(view(spark, sf_dir, "obs_ter"), folder)
    return text.read_blank_separated(spark, folder, ["lat", "lon", "h"])


@_query("SELECT CAST(row_number() OVER (ORDER BY obs_id) AS BIGINT) AS i, g AS value FROM obs_ter", "obs_ter")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number on each line, in the order of the files and of their lines."""
    folder = _scratch(spark)
    view(spark, sf_dir, "obs_ter").repartitionByRange(3, "obs_id").sortWithinPartitions("obs_id").select(F.col("g").cast("string")).write.text(folder)
    return text.read_vector(spark, folder)
