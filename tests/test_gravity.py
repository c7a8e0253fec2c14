import glob
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.functions import gravity as G
from plumbline.functions import spherical as S
from plumbline.functions import text as X
from plumbline.operators import blocks, design, estimation, grids, harmonics, kernels, lines, outliers, quality_control, restore, stats
from plumbline.roles import ColumnRoles, MissingColumnsError, require_columns

OBS = "obs_id long, project string, line long, seq long, lat double, lon double, h double, g double"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_normal_gravity_at_equator_and_pole(spark):
    r = one(spark, a=G.normal_gravity(F.lit(0e0)), b=G.normal_gravity(F.lit(90e0)), c=G.gravity_at_height(F.lit(45e0), F.lit(0e0)) - G.normal_gravity(F.lit(45e0)))
    assert r["a"] == pytest.approx(C.GAMMA_EQUATOR, abs=1e-6) and r["b"] == pytest.approx(C.GAMMA_POLE, abs=1e-6) and r["c"] == 0


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("double")
    r = one(spark, a=G.disturbance(null, F.lit(1e0), F.lit(1e0)), b=S.haversine(null, null, F.lit(1e0), F.lit(1e0)), c=S.clamp(null, -1, 1), d=G.pixel_normal_height(null, F.lit(1e0), F.lit(1e0)), e=stats.clip(null, 0, 1))
    assert all(v is None for v in r)


def test_height_type_and_land_or_sea(spark):
    r = one(spark, a=G.height_type(F.lit(2e0)), b=G.height_type(F.lit(-2.1e0)), sea=G.pixel_normal_height(F.lit(0e0), F.lit(9e0), F.lit(2e0)), land=G.pixel_normal_height(F.lit(5e0), F.lit(9e0), F.lit(2e0)))
    assert tuple(r) == (1.0, 0.0, -2.0, 7.0)


def test_longitude_wrap(spark):
    r = one(spark, a=S.wrap_longitude(F.lit(180e0)), b=S.wrap_longitude(F.lit(180.5e0)))
    assert tuple(r) == (180.0, -179.5)


def test_projection_origin_and_scale(spark):
    frame = spark.createDataFrame([(C.TM_LAT0, C.TM_LON0), (C.TM_LAT0 + 1e-4, C.TM_LON0), (36.0, -109.0)], "lat double, lon double")
    a, b, far = S.with_projection(frame).orderBy("lat").collect()
    assert a["x"] == pytest.approx(C.TM_EAST, abs=1e-6) and a["y"] == pytest.approx(C.TM_NORTH, abs=1e-6)
    assert (b["y"] - a["y"]) / 1e-4 == pytest.approx(C.TM_SCALE * 110578.6, rel=1e-4)
    assert far["x"] < a["x"] and far["y"] > a["y"]


def test_text_functions(spark):
    r = one(spark, a=X.safe_filename(F.lit(' a/b:c ')), b=X.is_true(F.lit(" SÍ ")), c=X.is_true(F.lit("no")), d=X.tile_name(F.lit(5), F.lit(-75)), e=X.prefix_match(F.lit("rest"), F.lit("restore")))
    assert tuple(r) == ("a_b_c", True, False, "N05W075", True)


def test_band_filter():
    assert (S.band_filter("Shannon", 5) == 1).all()
    cup = S.band_filter("Cup", 9)
    assert cup[0] == 1 and (np.diff(cup) < 0).all()


def test_roles(spark):
    raw = spark.createDataFrame([("1", " 36.5", "x", "2.5")], "id string, la string, lo string, v string")
    r = ColumnRoles("la", "lo", None, "v", key="id").apply(raw).first()
    assert (r["obs_id"], r["lon"], r["h"], r["g"]) == (1, None, 0.0, 2.5)
    with pytest.raises(MissingColumnsError):
        require_columns(raw, "nope")


# ----------------------------------------------------------------------------------------------- lines


def line(spark, values, project="p", number=1, step=0.01):
    return spark.createDataFrame([(i, project, number, i, 36.0 + step * i, -109.0, 0.0, v) for i, v in enumerate(values)], OBS)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=12))
def test_filter_stays_within_values(spark, values):
    out = [r["filtered"] for r in lines.gaussian_filter(line(spark, values), 3.0).collect()]
    assert min(values) - 1e-9 <= min(out) and max(out) <= max(values) + 1e-9


@pytest.mark.parametrize("step", [0.01, 0.2])
def test_filter_in_blocks_equals_join(spark, monkeypatch, step):
    monkeypatch.setattr(lines, "BLOCK", 7)
    values = np.random.default_rng(1).normal(size=60).tolist()
    obs = line(spark, values, step=step).unionByName(line(spark, values[:5], "q").withColumn("obs_id", F.col("obs_id") + 1000))
    a = {r["obs_id"]: r["filtered"] for r in lines.gaussian_filter(obs, 3.0).collect()}
    b = {r["obs_id"]: r["filtered"] for r in lines.gaussian_filter(obs, 3.0, long_line=10).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_balls_in_reach_equal_all_pairs(spark):
    """Balls of all sizes: the same pairs as by comparing all, and for a longer line in proportion more are met."""
    rng = np.random.default_rng(6)
    for n, reach in ((60, 0.05), (60, 0.4), (1, 0.1)):
        rows = [(str(i % 2), 0, i, *map(float, rng.uniform(-1, 1, 3)), float(10 ** rng.uniform(-4, 0))) for i in range(n)]
        got = sorted((r["project"], r["block"], r["block2"]) for r in lines.balls_in_reach(spark.createDataFrame(rows, "project string, line long, block long, x double, y double, z double, r double"), reach).collect())
        assert got == sorted((a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and math.dist(a[3:6], b[3:6]) - a[6] - b[6] <= reach)

    def met(n):
        along = [(("p", 0, k, math.cos(0.01 * k / n * 50), math.sin(0.01 * k / n * 50), 0.0, 0.2 / n)) for k in range(n)]
        frame = lines.balls_in_reach(spark.createDataFrame(along, "project string, line long, block long, x double, y double, z double, r double"), 0.5 / n)
        return frame.count()

    assert met(800) < 2.2 * met(400)


def test_filter_edge_rows(spark):
    rows = [(0, "p", 1, 0, 36.0, -109.0, 0.0, 1.0), (1, "p", 1, 1, None, -109.0, 0.0, 2.0), (2, "p", 1, 2, 36.0, -109.0, 0.0, float("nan")), (3, None, 1, 3, 36.0, -109.0, 0.0, 4.0), (4, "q", 7, 0, 36.0, -109.0, 0.0, 9.0)]
    obs = spark.createDataFrame(rows, OBS)
    out = {r["obs_id"]: r["filtered"] for r in lines.gaussian_filter(obs, 3.0).collect()}
    assert out == {0: 1.0, 1: None, 2: None, 3: None, 4: 9.0}
    assert lines.gaussian_filter(obs.limit(0), 3.0).count() == 0


def sequential(along, spacing):
    targets, picks, last = np.arange(0, along[-1] + spacing, spacing), [], -1
    for t in targets:
        i = int(np.argmin(np.abs(along - t)))
        if i <= last:
            i = last + 1
            if i >= len(along):
                break
        picks.append(i)
        last = i
    return picks


@pytest.mark.parametrize(("spacing", "most"), [(300.0, 10**6), (1000.0, 10**6), (1700.0, 10**6), (9000.0, 10**6), (300.0, 5), (1700.0, 5)])
def test_subsample_equals_sequential_rule(spark, spacing, most, monkeypatch):
    monkeypatch.setattr(lines, "WINDOW_LINE", most)  # 5: lines parted in ranges
    monkeypatch.setattr(lines, "TARGET_BLOCK", 7)
    rng = np.random.default_rng(3)
    lat = 36 + np.cumsum(rng.choice([0, 0.004, 0.01, 0.02], 40))
    obs = spark.createDataFrame([(i, "p", 1, i, float(x), -109.0, 0.0, 0.0) for i, x in enumerate(lat)], OBS)
    rows = lines.line_distances(obs).orderBy("seq").collect()
    along = np.array([r["along"] for r in rows])
    assert rows[0]["step"] is None and np.allclose(np.cumsum([r["step"] or 0 for r in rows]), along)
    got = sorted(r["obs_id"] for r in lines.distance_subsample(obs, spacing).collect())
    assert got == sequential(along, spacing)


def test_subsample_keeps_single_point(spark):
    assert lines.distance_subsample(line(spark, [1.0]), 100.0).count() == 1


# ----------------------------------------------------------------------------------------------- statistics


def test_exact_quantiles_narrow_down(spark, monkeypatch):
    monkeypatch.setattr(stats, "SORTED_VALUES", 50)
    v = np.concatenate([np.random.default_rng(0).normal(size=3000), np.full(500, 0.25)])
    frame = spark.createDataFrame([(float(x),) for x in v], "v double").union(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
    got = stats.exact_quantiles(frame, F.col("v"), [0, 0.25, 0.5, 0.99, 1])
    assert got == pytest.approx(np.quantile(v, [0, 0.25, 0.5, 0.99, 1]).tolist(), abs=1e-12)
    assert stats.exact_quantiles(frame.limit(0), F.col("v"), [0.5]) == [None]


def test_quantiles_with_infinities_ties_and_extremes(spark, monkeypatch):
    monkeypatch.setattr(stats, "SORTED_VALUES", 50)
    rng = np.random.default_rng(1)
    inf = float("inf")
    columns = {"a": [*rng.normal(size=900), *[inf] * 60, *[-inf] * 40], "b": [*rng.normal(size=300) * 1e-300, *[1.7e308, -1.7e308] * 350], "c": [3.0] * 1000, "d": [inf] * 1000}
    frame = spark.createDataFrame([tuple(float(columns[c][i]) for c in "abcd") for i in range(1000)], "a double, b double, c double, d double").repartition(4)
    got = stats.quantiles_of(frame, list("abcd"), [0.0, 0.02, 0.25, 0.5, 0.9, 1.0])
    for c, v in columns.items():
        v = np.sort(v)
        for share, x in zip((0.0, 0.02, 0.25, 0.5, 0.9, 1.0), got[c], strict=True):
            at = share * 999
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert x == pytest.approx(low if low == high else low + (high - low) * (at - math.floor(at)), rel=1e-12), (c, share)
    assert stats.nmad(frame, F.col("a"))[0] == pytest.approx(np.median(columns["a"]))


def test_quantiles_take_two_scans(spark):
    """Every row is read twice, however many columns and shares; adversarial orders and ties are exact."""
    rng = np.random.default_rng(4)
    n = 60_000
    columns = {"a": np.sort(rng.standard_cauchy(n)), "b": np.r_[np.zeros(n // 2), rng.normal(size=n // 2)], "c": np.where(np.arange(n) % 2, np.arange(n), -np.arange(n)).astype(float)}
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(pd.DataFrame(columns)).repartition(5).mapInArrow(count, "a double, b double, c double")
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = stats.quantiles_of(frame, list("abc"), shares)
    assert read.value == 2 * n
    for c, v in columns.items():
        assert got[c] == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12, abs=1e-12)


def test_column_stats_have_medians(spark):
    frame = spark.createDataFrame([(1.0, None), (3.0, None), (8.0, None), (float("nan"), None)], "a double, b double")
    assert [(r["column"], r["n"], r["median"]) for r in stats.column_stats(frame, ["a", "b"]).collect()] == [("a", 3, 3.0)]


def test_grouped_median_equals_sorting(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=700), 1: rng.normal(size=5), 2: np.full(400, 2.5), 3: rng.standard_cauchy(301), 4: np.repeat([1.0, 2.0], 200)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(0, float("inf")), (1, float("nan")), (5, None)]
    got = {r["k"]: r["median"] for r in stats.grouped_median(spark.createDataFrame(rows, "k long, v double").repartition(5), "k", "v", 20, 8).collect()}
    assert got == pytest.approx({g: float(np.median(v)) for g, v in groups.items()}, abs=1e-12)


def test_histogram_closes_last_bin(spark):
    frame = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    rows = stats.histogram(frame, F.col("v"), 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == np.histogram(range(11), 5)[0].tolist()
    assert sum(r["density"] * 2 for r in rows) == pytest.approx(1)
    assert stats.histogram(frame.limit(0), F.col("v"), 5).count() == 0


def test_finite_range_widens(spark):
    r = stats.finite_range(spark.createDataFrame([(2.0,), (2.0,), (float("inf"),)], "v double"), "v").first()
    assert tuple(r) == (2.0 - 1e-6, 2.0 + 1e-6)


def test_three_sigma_on_bound_is_neither(spark):
    rows = [(i, 100.0, 0.0) for i in range(4)]
    found = quality_control.three_sigma_by_height(spark.createDataFrame(rows, "obs_id long, h double, difference double")).collect()
    assert all(r["kept"] is None and r["height_class"] == "low" for r in found)


# ----------------------------------------------------------------------------------------------- grids


def test_reuter_counts(spark):
    n = 20
    rows = grids.reuter_rows(spark, n).orderBy("l").collect()
    for r in rows:
        phi, d = -math.pi / 2 + r["l"] * math.pi / (n + 1), math.pi / (n + 1)
        assert r["count"] == int(2 * math.pi / math.acos((math.cos(d) - math.sin(phi) ** 2) / math.cos(phi) ** 2))
    assert grids.reuter_nodes(spark, n).count() == sum(r["count"] for r in rows)


def test_bilinear_is_exact_on_planes(spark):
    grid = spark.createDataFrame([(r, c, 2.0 * r - 3.0 * c) for r in range(5) for c in range(6)], "r int, c int, value double")
    points = spark.createDataFrame([(0, 1.25, 2.5), (1, 4.0, 5.0), (2, 9.0, 1.0), (3, None, 1.0)], "k long, lat double, lon double")
    got = {r["k"]: r["sampled"] for r in grids.bilinear(points, grid, "k", 0, 0, 1).collect()}
    assert got == pytest.approx({0: 2 * 1.25 - 3 * 2.5, 1: 8.0 - 15.0})
    zero = {r["k"]: r["sampled"] for r in grids.bilinear(points, grid, "k", 0, 0, 1, "zero").collect()}
    assert zero[2] == 0.0 and zero[3] == 0.0


def test_raster_dedupe_and_full(spark):
    p = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0 + 1e-12, 1.0, 4.0), (2.0, 3.0, 5.0)], "lat double, lon double, value double")
    d = grids.raster_dedupe(p)
    assert sorted(tuple(r) for r in d.collect()) == [(1.0, 1.0, 3.0, 2), (2.0, 3.0, 5.0, 1)]
    assert grids.full_raster(d).count() == 4


# ----------------------------------------------------------------------------------------------- outliers


def spots(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, lat double, lon double, value double")


def test_outliers(spark):
    near = [(i, 5.0 + 0.01 * (i % 8), -74.0 + 0.01 * (i // 8), float(i % 3)) for i in range(60)]
    rows = [*near, (100, 5.035, -73.97, 500.0), (101, 5.0, -74.0, 90.0), (102, 50.0, 10.0, -400.0), (103, None, 1.0, 3.0)]
    got = {r["obs_id"]: r for r in outliers.detect(spots(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[100]["is_outlier"] and got[101]["is_outlier"]
    assert got[101]["interp"] == 0.0  # the reference point at the same place
    assert not got[102]["is_outlier"] and got[102]["difference"] == 0.0  # nobody near
    assert not got[103]["is_outlier"] and not any(got[i]["is_outlier"] for i in range(60))
    assert outliers.detect(spots(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 5, 2800])
@pytest.mark.parametrize("most", [0, 5_000_000])
def test_surroundings_by_tiles_and_bins(spark, monkeypatch, most, k):
    """Both ways against sums over all pairs: tiles of few candidates, and bins where tiles would hold too many points."""
    for name, value in (("TILE_POINTS", most), ("TILE_CANDIDATES", 3), ("BINS", 9)):
        monkeypatch.setattr(outliers, name, value)
    rng = np.random.default_rng(21)
    xy, v = rng.uniform(-3e5, 3e5, (300, 2)).round(-4), rng.normal(size=300).round(1)
    frame = spark.createDataFrame([(i, float(x), float(y), float(a)) for i, ((x, y), a) in enumerate(zip(xy, v))], "obs_id long, x double, y double, value double")
    chosen, rest = frame.where("obs_id % 9 = 0"), frame.where("obs_id % 9 <> 0")
    placed = chosen.select(F.col("obs_id").alias("cand"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    got = {r["cand"]: r for r in outliers.surroundings(placed, rest, 1e5, 0.0, 1.0, k).collect()}
    means = {r["cand"]: r["interp"] for r in outliers.nearest_means(chosen, rest, 1e5, k).collect()}
    for i in range(0, 300, 9):
        near = sorted((math.dist(xy[i], xy[j]), j) for j in range(300) if j % 9 and math.dist(xy[i], xy[j]) <= 1e5)
        values = np.array([v[j] for _, j in near])
        zero = [v[j] for d, j in near[:k] if d == 0]
        interp = zero[0] if zero else sum(v[j] / d for d, j in near[:k]) / sum(1 / d for d, _ in near[:k])
        assert got[i]["interp"] == pytest.approx(interp, rel=1e-9, abs=1e-12) and means[i] == pytest.approx(interp, rel=1e-9, abs=1e-12)
        assert got[i]["local"] == pytest.approx(8 * C.NMAD_FACTOR * np.median(np.abs(values - np.median(values))), rel=1e-12)


@pytest.mark.parametrize("k", [5, 2800])
def test_outliers_equal_brute_force(spark, monkeypatch, k):
    """Means of the k nearest, medians and deviations of all around, with few bins, ties and points at one place."""
    monkeypatch.setattr(outliers, "BINS", 7)
    rng = np.random.default_rng(8)
    lat, lon, v = np.round(rng.uniform(4, 6, 150), 2), np.round(rng.uniform(-75, -73, 150), 2), np.round(rng.standard_t(2, 150), 1)
    lat[:4], lon[:4] = lat[4:8], lon[4:8]
    rows = [(i, float(a), float(b), float(x)) for i, (a, b, x) in enumerate(zip(lat, lon, v))]
    got = {r["obs_id"]: r for r in outliers.detect(spots(spark, rows), k=k).collect()}
    at = {r["obs_id"]: (r["x"], r["y"]) for r in S.with_projection(spots(spark, rows)).collect()}
    med = np.median(v)
    spread = C.NMAD_FACTOR * np.median(np.abs(v - med))
    far, eps = np.abs(v - med) > 3 * spread, np.quantile(np.abs(v), 0.99)
    assert far.sum() > 3
    for i in range(150):
        if not far[i]:
            assert got[i]["interp"] == v[i] and not got[i]["is_outlier"]
            continue
        near = sorted((math.dist(at[i], at[j]), j) for j in range(150) if not far[j] and math.dist(at[i], at[j]) <= 100_000)
        values = np.array([v[j] for _, j in near])
        local = 8 * C.NMAD_FACTOR * np.median(np.abs(values - np.median(values)))
        zero = [v[j] for d, j in near[:k] if d == 0]
        interp = zero[0] if zero else sum(v[j] / d for d, j in near[:k]) / sum(1 / d for d, _ in near[:k])
        off = abs(v[i] - interp)
        assert got[i]["interp"] == pytest.approx(interp, rel=1e-9, abs=1e-9)
        assert got[i]["is_outlier"] == ((off > eps and abs(v[i]) > eps) or off > local)


def test_outliers_by_tiles_equal_those_by_bins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = spots(spark, [(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.uniform(4, 8, 250), rng.uniform(-77, -72, 250), rng.standard_cauchy(250).round(2)))])

    def found():
        return sorted((r["obs_id"], round(r["interp"], 9), r["is_outlier"], r["is_candidate"]) for r in outliers.detect(frame, k=20).collect())

    monkeypatch.setattr(outliers, "TILE_CANDIDATES", 4)
    tiles = found()
    monkeypatch.setattr(outliers, "TILE_POINTS", 0)
    assert tiles == found()


@pytest.mark.parametrize("k", [1, 40, 2800])
@pytest.mark.parametrize("digits", [9, -4])
def test_circles_by_cells_equal_all_distances(k, digits):
    """Medians, deviations and means of many points, of which cells tell most, against distances to all of them; also with points
    and values at equal places, candidates beyond the points' cells, and values that are NaN."""
    rng = np.random.default_rng(17)
    n, m = 3000, 80
    (x, y), v = rng.uniform(-1.5e5, 1.5e5, (2, n)).round(digits), rng.standard_cauchy(n).round(1)
    v[:2] = np.nan
    cx, cy = np.concatenate([[x[:9], y[:9]], rng.uniform(-2.6e5, 2.6e5, (2, m - 9))], axis=1)
    reference = pa.table({"ref": pa.array(rng.permutation(n)), "ref_value": pa.array(v), "x": pa.array(x), "y": pa.array(y)})
    candidates = pa.table({"cand": pa.array(np.arange(m)), "cx": pa.array(cx), "cy": pa.array(cy)})
    want, got = ({c: (a, b) for c, a, b in outliers._judged(candidates, reference, 1e5, k, 1.0, few)} for few in (n, n - 1))
    assert want.keys() == got.keys() and 9 < len(want) < m
    for c, (interp, mad) in want.items():
        assert got[c][0] == (None if interp is None else pytest.approx(interp, rel=1e-9, abs=1e-12))
        assert got[c][1] == pytest.approx(mad, rel=0, abs=0, nan_ok=True)


def test_circles_by_cells_measure_few_points(monkeypatch):
    """A circle of most of the points measures those on its edge, of a few slices and near its centre."""
    rng = np.random.default_rng(18)
    n, measured = 60_000, []
    (x, y), v = rng.uniform(-1e5, 1e5, (2, n)), rng.normal(size=n)
    reference = pa.table({"ref": pa.array(np.arange(n)), "ref_value": pa.array(v), "x": pa.array(x), "y": pa.array(y)})
    candidates = pa.table({"cand": pa.array([1]), "cx": pa.array([0.0]), "cy": pa.array([0.0])})
    apart = outliers._Cells._apart
    monkeypatch.setattr(outliers._Cells, "_apart", lambda self, a, *rest: measured.append(len(a)) or apart(self, a, *rest))
    assert len(outliers._judged(candidates, reference, 1e5, 500, 1.0, 16_384)) == 1
    assert sum(measured) < n / 4


def test_outliers_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.uniform(4, 7, 200), rng.uniform(-76, -72, 200), rng.standard_cauchy(200)))]
    frame = spots(spark, rows)
    a, b = (sorted((r["obs_id"], round(r["interp"], 9), r["is_outlier"]) for r in outliers.detect(f).collect()) for f in (frame.coalesce(1), frame.repartition(7)))
    assert a == b


# ----------------------------------------------------------------------------------------------- model


def nodes_and_points(rng, n=6, m=200):
    basis = design.Basis(np.arange(n), rng.uniform(36, 39, n), rng.uniform(-109, -103, n), 20)
    return basis, [(i, float(a), float(o), 1000.0) for i, (a, o) in enumerate(zip(rng.uniform(36, 39, m), rng.uniform(-109, -103, m)))]


def test_clenshaw_equals_legendre():
    rng = np.random.default_rng(0)
    c, t = rng.normal(size=(3, 30)), rng.uniform(-1, 1, (3, 4))
    want = [[np.polynomial.legendre.legval(t[i, j], c[i]) for j in range(4)] for i in range(3)]
    assert np.allclose(design.clenshaw(c, t), want)


@pytest.mark.parametrize("degree", [6, 150, 3600])
@pytest.mark.parametrize("potential", [False, True])
def test_kernel_tables_equal_sums(degree, potential):
    """Relative error below 1e-12, also at a node itself and across intervals of height, and ten times fewer terms."""
    rng = np.random.default_rng(degree)
    for kernel in ("Shannon", "Cup"):
        basis = design.Basis(np.arange(60), rng.uniform(36, 39, 60), rng.uniform(-109, -103, 60), degree, kernel)
        lat, lon, h = rng.uniform(36, 39, 25), rng.uniform(-109, -103, 25), rng.uniform(-50, 9_000, 25)
        lat[0], lon[0], lat[1], lon[1] = basis.lat[0], basis.lon[0], -basis.lat[1], basis.lon[1] + 180
        a, b = (design.design_rows(basis, lat, lon, h, potential, x) for x in (False, True))
        assert np.abs(a - b).max() <= 1e-12 * np.abs(a).max()
    table = basis.table(potential)
    assert degree < 1000 or table.terms * 10 < degree
    assert "_tables" not in pickle.loads(pickle.dumps(basis)).__dict__


def test_tables_of_one_panel_and_of_two_equal_sums():
    rng = np.random.default_rng(2)
    table = kernels.KernelTable(2.0 * np.arange(7) + 1, design.clenshaw_beside)
    for reach in (1.0, 3.0):  # one panel, and two
        t, s = np.cos(rng.uniform(0, reach, (40, 30))), rng.uniform(-2e-3, 1e-3, 40)
        want = design.clenshaw(table.factors * np.exp((np.arange(7) + 1) * s[:, None]), t)
        assert np.allclose(table.sums(t, s), want, rtol=0, atol=1e-12 * np.abs(table.factors).sum())


def test_terms_of_tables_follow_their_bound():
    """exp(i x) and exp(x) on intervals of half width w: as many terms as the bound says are enough."""
    for reach in (0.5, 4.0, 20.0):
        for along_real, f in ((False, lambda x: np.cos(reach * x)), (True, lambda x: np.exp(reach * x))):
            n = kernels.terms_needed(reach, along_real)
            c = kernels.to_coefficients(n) @ f(kernels.chebyshev_points(n))
            x = np.linspace(-1, 1, 501)
            assert np.abs(np.polynomial.chebyshev.chebval(x, c) - f(x)).max() < 1e-13 * np.exp(reach if along_real else 0)


def test_clenshaw_near_one():
    """Differences keep the digits that cosines near 1 lose."""
    less = -2 * np.sin(np.array([[0.0, 1e-9, 1e-6, 1e-4]]) / 2) ** 2
    n = np.arange(3601)
    got = design.clenshaw_beside(np.ones((1, 3601)), less)[0]
    assert got[0] == pytest.approx(3601, rel=1e-13) and got[1] == pytest.approx(3601, rel=1e-11)
    want = [sum(1 - k * (k + 1) * x * x / 4 + (k - 1) * k * (k + 1) * (k + 2) * x**4 / 64 for k in n.tolist()) for x in (1e-6, 1e-4)]
    assert got[2] == pytest.approx(want[0], rel=1e-12) and got[3] == pytest.approx(want[1], rel=1e-3)


def test_synthesis_is_linear_and_partition_invariant(spark):
    rng = np.random.default_rng(1)
    basis, rows = nodes_and_points(rng)
    points = spark.createDataFrame(rows, "pixel_id long, lat double, lon double, h double")
    a, b = rng.normal(size=6), rng.normal(size=6)

    def run(frame, beta):
        return np.array([r["potential"] for r in design.synthesise(frame, basis, beta).orderBy("pixel_id").collect()])

    assert np.allclose(run(points, a) + 2 * run(points.repartition(5), b), run(points, a + 2 * b))


def test_estimation_recovers_parameters(spark):
    rng = np.random.default_rng(2)
    basis, rows = nodes_and_points(rng, 5, 400)
    truth = rng.normal(size=5) * 1e3
    x = design.design_rows(basis, *(np.array([r[k] for r in rows]) for k in (1, 2, 3)))
    noise = 1e-3 * np.abs(x @ truth).mean()
    y = x @ truth + rng.normal(size=400) * noise
    obs = spark.createDataFrame([(*r, float(v), "a" if r[0] % 2 else "b") for r, v in zip(rows, y)], "obs_id long, lat double, lon double, h double, y double, group_id string")
    systems = design.normal_systems(obs, basis, n_probes=1)
    assert np.allclose(sum(s.xx for s in systems.values()), x.T @ x, rtol=1e-9)
    again = design.normal_systems(obs.repartition(6), basis, n_probes=1)
    assert all(np.allclose(systems[g].xu, again[g].xu) for g in systems)
    found = estimation.estimate_components(systems, sigma2_mu=1e12, textbook=True, exact_trace=True)
    assert found.sigma2["a"] == pytest.approx(noise**2, rel=0.4)
    std = np.sqrt(np.diag(found.covariance()))
    assert (np.abs(found.beta - truth) < 6 * std + 1e-6 * np.abs(truth)).all()
    accurate = estimation.estimate_components(systems, sigma2_mu=1e12, max_iter=2, residual_pass=(obs, basis))
    assert accurate.iterations <= 2 and np.isfinite(accurate.history).all()
    corner = estimation.l_curve(systems, found)
    assert corner.coarse.shape == (20, 3) and len(corner.fine) == 20 and np.isfinite(corner.beta).all()
    e = np.array([r["residual"] for r in design.residuals(obs, basis, found.beta).orderBy("obs_id").collect()])
    assert np.allclose(e, y - x @ found.beta)


def test_reference_redundancy_equals_textbook_at_unit_variance():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=50)
    systems = {"a": design.Normal(50, x.T @ x, x.T @ y, y @ y)}
    a = estimation.estimate_components(systems, max_iter=1)
    b = estimation.estimate_components(systems, max_iter=1, textbook=True)
    assert np.allclose(a.history, b.history)


def expanded_case(spark, m=150):
    """More nodes than harmonics, and observations of two groups."""
    rng = np.random.default_rng(11)
    basis = design.Basis(np.arange(m) * 3, rng.uniform(-80, 80, m), rng.uniform(-180, 180, m), 6)
    rows = [(i, float(a), float(o), float(h), float(y), "ab"[i % 2]) for i, (a, o, h, y) in enumerate(zip(rng.uniform(-80, 80, 400), rng.uniform(-180, 180, 400), rng.uniform(0, 3e3, 400), rng.normal(size=400)))]
    return basis, spark.createDataFrame(rows, "obs_id long, lat double, lon double, h double, y double, group_id string")


@pytest.mark.parametrize("potential", [False, True])
def test_expansion_equals_design(potential):
    rng = np.random.default_rng(3)
    lat, lon, h = np.array([-90.0, 90.0, 0.0, 36.1, 41.0]), np.array([0.0, 10.0, 180.0, -109.0, 77.0]), np.array([0.0, 1e3, -50.0, 3e3, 10.0])
    for n_max in (0, 1, 6, 20):
        basis = design.Basis(np.arange(700), rng.uniform(-90, 90, 700), rng.uniform(-180, 180, 700), n_max, n_min=min(n_max, 2))
        assert basis.expands
        x = design.design_rows(basis, lat, lon, h, potential, tabulated=False)
        assert np.allclose(basis.point_terms(lat, lon, h, potential) @ basis.node_terms().T, x, rtol=0, atol=1e-13 * np.abs(x).max())


def test_sweeps_of_more_nodes_than_fit_dense(spark, monkeypatch):
    basis, obs = expanded_case(spark)
    dense = design.normal_systems(obs, basis, n_probes=1)
    want = estimation.l_curve(dense, estimation.estimate_components(dense, sigma2_mu=1e6, max_iter=4, tol=0.0))
    monkeypatch.setattr(design, "DENSE_BYTES", 100_000)  # a matrix of 150 nodes has 180,000
    systems = estimation.systems_of(obs, basis, n_probes=1)
    assert isinstance(systems, estimation.ExpandedSystems)
    got = estimation.l_curve(systems, estimation.estimate_components(systems, sigma2_mu=1e6, max_iter=4, tol=0.0))
    assert np.allclose(got.coarse, want.coarse, rtol=1e-6) and np.allclose(got.fine, want.fine, rtol=1e-6)
    assert np.allclose(got.beta, want.beta, rtol=1e-6, atol=1e-9 * np.abs(want.beta).max())
    with pytest.raises(ValueError, match="diagonal"):
        got.factor.inverse()


@pytest.mark.parametrize("options", [{}, {"exact_trace": True}, {"textbook": True}])
def test_components_of_more_nodes_than_fit_dense(spark, monkeypatch, options):
    basis, obs = expanded_case(spark)
    want = estimation.estimate_components(design.normal_systems(obs, basis, n_probes=1), sigma2_mu=1e6, max_iter=3, tol=0.0, **options)
    monkeypatch.setattr(design, "DENSE_BYTES", 100_000)
    got = estimation.estimate_components(estimation.systems_of(obs, basis, n_probes=1), sigma2_mu=1e6, max_iter=3, tol=0.0, **options)
    assert np.allclose(got.history, want.history, rtol=1e-6, atol=0)
    assert np.allclose(got.factor.diagonal(), want.factor.diagonal(), rtol=1e-6)


def test_systems_choose_their_form(spark, monkeypatch):
    basis, obs = expanded_case(spark, 20)
    assert isinstance(estimation.systems_of(obs, basis), estimation.DenseSystems)
    monkeypatch.setattr(design, "DENSE_BYTES", 6_399)  # both groups' matrices have 6,400
    assert isinstance(estimation.systems_of(obs, basis, n_probes=1), blocks.BlockSystems)


def falling(i, j):
    return np.where(i == j, 2.0, 1 / (1.0 + np.abs(i - j)))


@pytest.mark.parametrize("m", [20, 150])
def test_deviations_without_a_matrix_of_nodes(spark, monkeypatch, m):
    """Of a covariance given by ids, in blocks, for bases that expand and that don't."""
    monkeypatch.setattr(design, "COVARIANCE_BLOCK", 64)
    basis, obs = expanded_case(spark, m)
    c = falling(basis.node_id[:, None], basis.node_id[None, :])
    lat, lon, h = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h"))
    x = design.design_rows(basis, lat, lon, h, True)
    for options in ({"covariance": falling}, {"factor": np.linalg.cholesky(c)}):
        got = design.synthesise(obs, basis, np.zeros(m), "obs_id", **options).orderBy("obs_id").collect()
        assert np.allclose([r["std_potential"] for r in got], np.sqrt(((x @ c) * x).sum(1)), rtol=1e-9)


def test_synthesis_of_more_nodes_than_terms(spark):
    basis, obs = expanded_case(spark)
    beta = np.random.default_rng(1).normal(size=150)
    lat, lon, h, y = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h", "y"))
    want = [design.design_rows(basis, lat, lon, h, potential) @ beta for potential in (True, False)]
    got = design.synthesise(obs, basis, beta, "obs_id").orderBy("obs_id").collect()
    assert np.allclose([r["potential"] for r in got], want[0], rtol=1e-9)
    e = design.residuals(obs, basis, beta).orderBy("obs_id").collect()
    assert np.allclose([r["residual"] for r in e], y - want[1], rtol=1e-9)
    assert design.spread(obs.coalesce(1)).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("m", [20, 150])
def test_right_side_makes_no_table(spark, m):
    basis, obs = expanded_case(spark, m)
    lat, lon, h, y = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h", "y"))
    missing = obs.withColumn("y", F.when(F.col("obs_id") % 7 != 0, F.col("y")))
    x, y = design.design_rows(basis, lat, lon, h), np.where(np.arange(400) % 7 != 0, y, 0)
    got = sorted(tuple(r) for r in design.right_side(missing, basis).collect())
    assert [i for i, _ in got] == basis.node_id.tolist()
    assert np.allclose([v for _, v in got], x.T @ y, rtol=1e-9, atol=1e-12 * np.abs(x).max())
    empty = design.right_side(obs.withColumn("y", F.lit(None).cast("double")), basis).collect()
    assert len(empty) == m and all(r["v"] is None for r in empty)
    assert design.right_side(obs.limit(0), basis).count() == 0


def test_entries_as_they_are_read(spark, monkeypatch):
    basis, obs = expanded_case(spark)
    lat, lon, h = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h"))
    x = design.design_rows(basis, lat, lon, h)
    got = {(r["i"], r["j"]): r["v"] for r in design.gram_entries(obs, basis, 2.0).collect()}
    assert len(got) == 150 * 150
    assert np.allclose([[got[i, j] for j in basis.node_id.tolist()] for i in basis.node_id.tolist()], 2 * x.T @ x, rtol=1e-9, atol=1e-12 * (x * x).sum(0).max())
    assert design.gram_entries(obs.limit(0), basis).count() == 0
    with pytest.raises(ValueError, match="blocks"):
        design.gram_entries(obs, expanded_case(spark, 20)[0])


@pytest.mark.parametrize("tabulated", [None, True])
def test_design_table_is_rounded_and_dealt(spark, tabulated):
    basis, obs = expanded_case(spark)
    lat, lon, h = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h"))
    found = design.design_matrix(obs.coalesce(1), basis, tabulated=tabulated, scale=1e6, digits=3)
    assert found.rdd.getNumPartitions() > 1
    got = [r["a"] for r in found.orderBy("obs_id", "node_id").collect()]
    assert np.allclose(got, 1e6 * design.design_rows(basis, lat, lon, h).ravel(), rtol=0, atol=5.01e-4) and np.allclose(got, np.round(got, 3), rtol=0, atol=1e-12)
    assert design.rounded(np.array([0.25, -0.25, 0.5, -1.5]), 1.0, 1).tolist() == [0.3, -0.3, 0.5, -1.5]


def crowded_case(spark, copies=5):
    """A basis of 60 positions, each of several nodes with ids far apart, and observations."""
    basis, obs = expanded_case(spark, 60)
    order = np.random.default_rng(2).permutation(60 * copies)
    return design.Basis(np.arange(60 * copies) * 3, basis.lat[order % 60], basis.lon[order % 60], 6), obs


def row_bytes(table, path):
    """Bytes of the columns for each row as Spark writes them."""
    table.write.parquet(path)
    groups = [m.row_group(k) for m in (pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")) for k in range(m.num_row_groups)]
    return sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns)) / sum(g.num_rows for g in groups)


def test_nodes_of_one_position_are_one_place():
    lat, lon = np.array([1.0, 0.0, 1.0, np.nan, 0.0, 0.0]), np.array([2.0, 5.0, 2.0, 0.0, 4.0, 5.0])
    places, ids, starts = design.Basis(np.array([7, 3, 1, 9, 8, 2]), lat, lon, 6).places()
    assert places.lat[:3].tolist() == [0, 0, 1] and places.lon.tolist() == [4, 5, 2, 0] and np.isnan(places.lat[3])
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [[8], [2, 3], [1, 7], [9]]
    assert len(design.Basis(np.zeros(0), np.zeros(0), np.zeros(0), 6).places()[0].lat) == 0


@pytest.mark.parametrize("tabulated", [None, True])
def test_design_table_keeps_columns_of_a_position_once(spark, monkeypatch, tmp_path, tabulated):
    """Equal to the rows of the design, whatever the blocks; the table as it is written takes few bytes a row."""
    monkeypatch.setattr(design, "LEFT_BLOCK", 7)
    monkeypatch.setattr(design, "BLOCK_NUMBERS", 70)
    monkeypatch.setattr(design, "TASK_ROWS", 3_000)
    basis, obs = crowded_case(spark)
    lat, lon, h = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h"))
    found = design.design_matrix(obs, basis, tabulated=tabulated)
    assert found.rdd.getNumPartitions() == 40
    got = found.orderBy("obs_id", "node_id").collect()
    assert [(r["obs_id"], r["node_id"]) for r in got] == [(k, i) for k in range(400) for i in basis.node_id.tolist()]
    assert np.allclose([r["a"] for r in got], design.design_rows(basis, lat, lon, h).ravel(), rtol=1e-9, atol=1e-12)
    assert design.design_matrix(obs.limit(0), basis).count() == 0
    monkeypatch.undo()
    crowded, _ = crowded_case(spark, 40)
    assert row_bytes(design.design_matrix(obs, crowded, tabulated=tabulated, scale=1e6, digits=3).coalesce(1), str(tmp_path / "a")) < 0.8


def test_points_of_a_task_are_near(spark):
    points = spark.range(0, 20_000).selectExpr("id k", "36 + 3 * ((id * 7919) % 10007) / 10007e0 lat", "-109 + 6 * ((id * 104729) % 10009) / 10009e0 lon", "0e0 h")
    dealt = design._dealt_by_place(points, 1).withColumn("t", F.spark_partition_id())
    sides = dealt.groupBy("t").agg((F.max("lat") - F.min("lat")).alias("a"), (F.max("lon") - F.min("lon")).alias("b"), F.count("*").alias("n")).collect()
    assert len(sides) == 16 and sum(r["n"] for r in sides) == 20_000
    assert max(r["a"] for r in sides) < 1.6 and max(r["b"] for r in sides) < 3 and max(r["n"] for r in sides) < 2_500


def test_entries_of_a_position_are_kept_once(spark, monkeypatch, tmp_path):
    basis, obs = crowded_case(spark)
    lat, lon, h = (np.array([r[0] for r in obs.orderBy("obs_id").select(x).collect()]) for x in ("lat", "lon", "h"))
    x = design.design_rows(basis, lat, lon, h)
    for left, numbers, entries in ((512, 262_144, 100_000), (7, 21, 100)):
        monkeypatch.setattr(design, "LEFT_BLOCK", left)
        monkeypatch.setattr(design, "BLOCK_NUMBERS", numbers)
        monkeypatch.setattr(design, "TASK_ENTRIES", entries)
        found = design.gram_entries(obs, basis, 2.0)
        got = {(r["i"], r["j"]): r["v"] for r in found.collect()}
        ids = basis.node_id.tolist()
        assert found.count() == len(got) == 300 * 300
        assert np.allclose([[got[i, j] for j in ids] for i in ids], 2 * x.T @ x, rtol=1e-9, atol=1e-12 * (x * x).sum(0).max())
    monkeypatch.undo()
    crowded, _ = crowded_case(spark, 20)
    assert row_bytes(design.gram_entries(obs, crowded), str(tmp_path / "v")) < 0.4


def test_dense_systems_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(0)
    basis, rows = nodes_and_points(rng, 5, 20)
    obs = spark.createDataFrame([(*r, 1.0, str(r[0] % 2)) for r in rows], "obs_id long, lat double, lon double, h double, y double, group_id string")
    for most in (100, 399):  # one matrix, and both groups' together
        monkeypatch.setattr(design, "DENSE_BYTES", most)
        with pytest.raises(ValueError, match="BlockSystems"):
            design.normal_systems(obs, basis)


def test_block_systems_equal_dense(spark):
    """Sums, solutions, variances, deviations, components and L-curve in blocks of 7 of 23 nodes against dense ones."""
    rng = np.random.default_rng(7)
    basis, rows = nodes_and_points(rng, 23, 300)
    basis = design.Basis(basis.node_id, basis.lat, basis.lon, 60)
    y = rng.normal(size=300) * 1e-5
    obs = spark.createDataFrame([(*r, float(v), "a" if r[0] % 3 else "b") for r, v in zip(rows, y)], "obs_id long, lat double, lon double, h double, y double, group_id string").repartition(3)
    dense = design.normal_systems(obs, basis, n_probes=2)
    system = blocks.BlockSystems.of(obs, basis, n_probes=2, block=7)
    for g, s in dense.items():
        t = system.sums[g]
        assert t.n == s.n and np.allclose(t.xy, s.xy, rtol=1e-10) and np.isclose(t.yy, s.yy) and np.allclose(t.xu, s.xu, rtol=1e-9)
    long = {(r["g"], r["i"], r["j"]): r["v"] for r in blocks.entries(system.blocks, basis, 7).collect()}
    assert len(long) == 2 * 23 * 23 and all(np.isclose(long[g, i, j], s.xx[i, j], rtol=1e-9, atol=1e-30) for g, s in dense.items() for i in range(23) for j in range(23))
    weights, ridge = {"a": 2.0, "b": 0.5}, 1e-9
    matrix = sum(weights[g] * s.xx for g, s in dense.items()) + ridge * np.eye(23)
    factor = system.factor(weights, ridge)
    right = rng.normal(size=(23, 3))
    assert np.allclose(factor.solve(right), np.linalg.solve(matrix, right), rtol=1e-5)
    assert np.allclose(factor.diagonal(), np.diag(np.linalg.inv(matrix)), rtol=1e-5)
    points = obs.select(F.col("obs_id").alias("pixel_id"), "lat", "lon", "h").limit(40)
    got = {r["pixel_id"]: r["std_potential"] for r in factor.deviations(points, basis, "pixel_id", 4.0, 7).collect()}
    root = np.linalg.cholesky(4.0 * np.linalg.inv(matrix))
    want = {r["pixel_id"]: r["std_potential"] for r in design.synthesise(points, basis, np.zeros(23), "pixel_id", root).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)
    a, b = (estimation.estimate_components(s, sigma2_mu=1e6, max_iter=2) for s in (dense, system))
    assert np.allclose(a.history, b.history, rtol=1e-4) and np.allclose(a.beta, b.beta, rtol=1e-3, atol=1e-6 * np.abs(a.beta).max())
    with pytest.raises(ValueError, match="exact traces"):
        estimation.estimate_components(system, exact_trace=True)


def block_case(spark, m, n, degree, block, probes=2):
    rng = np.random.default_rng(7)
    basis, rows = nodes_and_points(rng, m, n)
    basis = design.Basis(basis.node_id, basis.lat, basis.lon, degree)
    y = rng.normal(size=n) * 1e-5
    obs = spark.createDataFrame([(*r, float(v), "a" if r[0] % 3 else "b") for r, v in zip(rows, y)], "obs_id long, lat double, lon double, h double, y double, group_id string").repartition(3)
    return rng, obs, basis, design.normal_systems(obs, basis, n_probes=probes), blocks.BlockSystems.of(obs, basis, n_probes=probes, block=block)


@pytest.mark.parametrize(("m", "n", "degree", "block"), [(23, 300, 60, 7), (300, 900, 200, 80)])
def test_solutions_by_iteration(spark, m, n, degree, block):
    """Dense solutions to 1e-8, in a bounded number of passes over the design, and no matrix of nodes x nodes."""
    rng, obs, basis, dense, system = block_case(spark, m, n, degree, block)
    weights = {"a": 2.0, "b": 0.5}
    matrix = sum(weights[g] * s.xx for g, s in dense.items())
    ridge = 1e-3 * np.linalg.norm(matrix, 2)
    right = np.column_stack([sum(weights[g] * s.xy for g, s in dense.items()), *(s.xu for s in dense.values())])
    want = np.linalg.solve(matrix + ridge * np.eye(m), right)
    got = system.factor(weights, ridge).solve(right)
    assert np.abs(got - want).max() <= 1e-8 * np.abs(want).max()
    assert system.passes <= m // right.shape[1] + 8
    again = system.factor(weights, ridge * 1.001).solve(right)  # starts at what was found
    assert np.allclose(again, np.linalg.solve(matrix + 1.001 * ridge * np.eye(m), right), atol=1e-8 * np.abs(want).max())
    for lam in (ridge, ridge / 100):
        krylov = blocks.Lanczos(system, weights, right[:, 0])
        assert np.allclose(krylov.solution(lam), np.linalg.solve(matrix + lam * np.eye(m), right[:, 0]), rtol=1e-7, atol=1e-9 * np.abs(want[:, 0]).max())
    assert system._blocks is None


def test_sweeps_share_one_basis(spark):
    rng, obs, basis, dense, system = block_case(spark, 60, 400, 100, 16)
    found = estimation.estimate_components(dense, sigma2_mu=1e3, max_iter=3, textbook=True)
    a = estimation.l_curve(dense, found)
    before = system.passes
    b = estimation.l_curve(system, found)
    assert np.allclose(a.coarse, b.coarse, rtol=1e-6) and np.allclose(a.fine, b.fine, rtol=1e-6) and a.lam == pytest.approx(b.lam)
    assert np.allclose(a.beta, b.beta, rtol=1e-5, atol=1e-7 * np.abs(a.beta).max())
    assert system.passes - before <= 60 + 2 and system._blocks is None  # a basis vector each, and a pass for each sweep's norms
    assert np.allclose(b.factor.diagonal(), np.diag(a.factor.inverse()), rtol=1e-4)


def test_components_in_blocks_make_no_matrix(spark):
    rng, obs, basis, dense, system = block_case(spark, 40, 400, 60, 16)
    a, b = (estimation.estimate_components(s, sigma2_mu=1e3, max_iter=3, textbook=True) for s in (dense, system))
    assert np.allclose(a.history, b.history, rtol=1e-5) and system._blocks is None and system.passes <= 3 * 40


def test_tiles_of_sums_send_a_quarter(spark):
    """At 8 x 8 blocks a design block travels twice where it travelled eight times; results as they were."""
    rng, obs, basis, dense, system = block_case(spark, 64, 300, 30, 8, 0)
    sent, each = (blocks.dealt_blocks(system.design, 8, tile).agg(F.sum(F.length("v"))).first()[0] for tile in (blocks.TILE, 1))
    assert sent <= each / 4
    for tile in (1, 3, 4, 8):
        total = blocks.gram_blocks(system.design, 64, 8, tile)
        assert total.count() == 2 * 36
        for r in total.collect():
            want = dense[r["g"]].xx[8 * r["i"] : 8 * r["i"] + 8, 8 * r["j"] : 8 * r["j"] + 8]
            assert np.allclose(np.frombuffer(r["v"]).reshape(8, 8), want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_residual_pass_of_sources_numbered_alike(spark):
    """Two sources that both number from 0 keep their own residuals."""
    rng, obs, basis, dense, system = block_case(spark, 5, 200, 20, None, 0)
    alike = obs.withColumn("obs_id", F.floor(F.col("obs_id") / 3).cast("long"))
    sums, rows = (estimation.estimate_components(dense, sigma2_mu=1e3, max_iter=2, textbook=True, exact_trace=True, residual_pass=p) for p in (None, (alike, basis)))
    assert np.allclose(sums.history, rows.history, rtol=1e-6)


def test_parameters_must_rise():
    with pytest.raises(ValueError, match="rise"):
        estimation.spline_curvature(np.array([1.0, 2.0, 2.0, 3.0]), np.ones(4), np.ones(4))


def test_spline_reproduces_cubics():
    t = np.linspace(0, 3, 7)
    first, second = estimation.NotAKnot(t, t**3 - 2 * t).derivatives(np.array([0.3, 1.7, 2.9]))
    assert np.allclose(first, 3 * np.array([0.3, 1.7, 2.9]) ** 2 - 2) and np.allclose(second, 6 * np.array([0.3, 1.7, 2.9]))


def test_curvature_of_a_circle_and_fallback():
    a = np.linspace(0, 1, 9)
    k = estimation.menger_curvature(np.column_stack([2 * np.cos(a), 2 * np.sin(a)]))
    assert k[0] == k[-1] == 0 and np.allclose(k[1:-1], 0.5)
    assert estimation.pick_lambda(np.array([1.0, 2.0, 4.0]), np.array([1.0, 1.1, 3.0]), np.array([3.0, 1.1, 1.0])) == 1
    few = estimation.Components(np.zeros(1), np.eye(1), {"a": 1.0}, 1.0, np.ones((2, 2)), np.ones((2, 2)), 2)
    assert estimation.first_lambda(few) == 1.0


def test_student_quantile():
    for p, dof, want in ((0.9, 1, 3.077683537), (0.9, 10, 1.372183641), (0.95, 30, 1.697260887), (0.9, 1488, 1.282121)):
        assert estimation.student_quantile(p, dof) == pytest.approx(want, rel=2e-5)
    with pytest.raises(ValueError):
        estimation.student_quantile(0.9, 0)


def test_restore_settles(spark):
    rows = [(0, 36.0, 2000.0, 50.0, 300.0, 10.0, 0.1), (1, -10.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    pixels = spark.createDataFrame(rows, "pixel_id long, lat double, height double, potential double, model double, topo double, terrain double")
    done = restore.restore(pixels)
    assert restore.restore_error(done).first()[0] < 1e-6
    assert done.where("pixel_id = 1").first()["zeta"] == 0.0


def test_harmonics_addition_theorem():
    t = np.array([-0.7, 0.1, 0.93])
    functions = harmonics.Legendre(60, t, np.sqrt(1 - t * t), np.ones(3))
    for n in range(61):
        assert np.allclose((functions.advance() ** 2).sum(0), 2 * n + 1)


def test_harmonics_stay_finite_at_the_highest_degree():
    """Sums of squares are 2n + 1 at every latitude, up to degree 5480."""
    lat = np.radians([0.0, 30.0, 60.0, 85.0, 89.99])
    functions = harmonics.Legendre(5480, np.sin(lat), np.cos(lat), np.ones(5))
    for n in range(5481):
        p = functions.advance()
        if n % 500 == 0 or n == 5480:
            assert np.isfinite(p).all() and np.allclose((p**2).sum(0), 2 * n + 1, rtol=1e-8), n


@pytest.mark.parametrize(("n_max", "step", "count"), [(360, 0.25, 300), (40, 30.0, 12), (360, 4.0, 60), (100, 0.5, 720)])
def test_rings_equal_sums(n_max, step, count, monkeypatch):
    """Parallels by transforms, also with fewer places than orders, against the sum for each point."""
    rng = np.random.default_rng(n_max)
    size = harmonics.row_of(n_max).stop
    model = rng.normal(size=size) * 1e-6, rng.normal(size=size) * 1e-6
    lon = -171.3 + step * np.arange(count)
    points = {"lat": np.repeat([31.5, -62.25], count), "lon": np.tile(lon, 2), "h": np.zeros(2 * count)}
    got = harmonics.synthesise(points, model, 2, n_max, "potential", C.MODEL_GM, C.MODEL_RADIUS)
    assert harmonics.ring_of(lon, n_max) is not None and harmonics.ring_of(lon + 1e-3 * rng.random(count), n_max) is None
    monkeypatch.setattr(harmonics, "ring_of", lambda *_: None)
    want = harmonics.synthesise(points, model, 2, n_max, "potential", C.MODEL_GM, C.MODEL_RADIUS)
    assert np.abs(got - want).max() <= 1e-9 * np.abs(want).max()


def test_harmonics_equal_a_long_sum():
    """Degree 60 with C and S against the standard recursion in extended precision."""
    rng = np.random.default_rng(3)
    top = 60
    c, s = rng.normal(size=(2, harmonics.row_of(top).stop))
    lat, lon, h = np.array([-71.0, 3.0, 3.0, 48.5]), np.array([10.0, -120.0, 55.0, 179.0]), np.array([0.0, 900.0, 900.0, 4000.0])
    got = harmonics.synthesise({"lat": lat, "lon": lon, "h": h}, (c, s), 2, top, "potential", C.MODEL_GM, C.MODEL_RADIUS)
    for k in range(4):
        e2 = np.longdouble(C.FLATTENING) * (2 - np.longdouble(C.FLATTENING))
        phi = np.radians(np.longdouble(lat[k]))
        n0 = C.AXIS_A / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        x, z = (n0 + h[k]) * np.cos(phi), (n0 * (1 - e2) + h[k]) * np.sin(phi)
        r = np.hypot(x, z)
        t, u = z / r, x / r
        p = np.zeros((top + 1, top + 1), np.longdouble)
        p[0, 0] = 1
        for n in range(1, top + 1):
            p[n, n] = p[n - 1, n - 1] * u * np.sqrt(np.longdouble(3 if n == 1 else 2 * n + 1) / (1 if n == 1 else 2 * n))
            for m in range(n):
                a = np.sqrt(np.longdouble((2 * n - 1) * (2 * n + 1)) / ((n - m) * (n + m)))
                b = np.sqrt(np.longdouble((2 * n + 1) * (n + m - 1) * (n - m - 1)) / ((n - m) * (n + m) * (2 * n - 3))) if n > 1 else 0
                p[n, m] = a * t * p[n - 1, m] - (b * p[n - 2, m] if n > 1 else 0)
        total = sum((C.MODEL_RADIUS / r) ** n * p[n, m] * (c[harmonics.row_of(n)][m] * np.cos(m * np.radians(lon[k])) + s[harmonics.row_of(n)][m] * np.sin(m * np.radians(lon[k]))) for n in range(2, top + 1) for m in range(n + 1))
        assert got[k] == pytest.approx(float(C.MODEL_GM / r * total), rel=1e-11)


def test_harmonics_of_degree_zero_and_normal_field(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 40.0, 10.0, 500.0), (2, None, 1.0, 1.0)], "obs_id long, lat double, lon double, h double")
    model = spark.createDataFrame([(0, 0, 1.0, 0.0), (2, 0, harmonics.NORMAL_ZONALS[2], 0.0)], "n int, m int, c double, s double")
    rows = {r["obs_id"]: r["value"] for r in harmonics.synthesis(points, model, 2, n_min=2, functional="disturbance", subtract_normal=True).collect()}
    assert rows == {0: 0.0, 1: 0.0}
    v = harmonics.synthesis(points, model, 2, functional="potential").where("obs_id = 0").first()["value"]
    assert v == pytest.approx(C.MODEL_GM / C.AXIS_A, rel=1e-3)


def test_mosaic_and_elevation(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (9, 9, 9.0)], "ilat long, ilon long, value double")
    got = {(r["ilat"], r["ilon"]): r["value"] for r in grids.mosaic(spark, cells, 0, 1, 0, 1, 1, 0.0).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 0.0}
    ground = spark.createDataFrame([(a / 2, o / 2, 10.0 * a + o) for a in range(3) for o in range(5)] + [(0.0, 0.0, 0.0)], "lat double, lon double, value double")
    points = spark.createDataFrame([(0, 0.25, 0.75), (1, 5.0, 5.0)], "k long, lat double, lon double")
    got = {r["k"]: r["elevation"] for r in grids.sample_elevation(points, ground, "k", 2).collect()}
    assert got[0] == pytest.approx(6.5) and got[1] is None
    assert grids.sample_elevation(points, ground, "k", 2, "nearest").where("k = 0").first()["elevation"] in (2.0, 12.0, 11.0, 1.0)


def test_geoid_grid(spark):
    model = spark.createDataFrame([(2, 0, 1e-6, 0.0), (2, 2, 1e-6, -1e-6)], "n int, m int, c double, s double")
    grid = harmonics.geoid_grid(grids.pixel_centres(spark, 0, 10, 0, 10, 5), model, 2)
    assert grid.count() == 4 and grid.where("abs(undulation) > 0 AND abs(undulation) < 100").count() == 4


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic"])
def test_resample(spark, method):
    from plumbline.operators.resample import resample

    def f(a, o):
        return {"nearest": 2.0, "linear": 3 * a - 2 * o + 1, "cubic": a**3 - 2 * a * o**2 + o**3}[method]

    raster = spark.createDataFrame([(a / 2, o / 2, f(a / 2, o / 2)) for a in range(7) for o in range(6)], "lat double, lon double, value double")
    rows = resample(raster, 0.2, 0.25, method).collect()
    assert len(rows) == 16 * 11 and all(r["value"] == pytest.approx(f(r["lat"], r["lon"]), abs=1e-9) for r in rows)
    outside = resample(raster, 0.5, 0.5, method, north=4.0).where("lat > 3").collect()
    assert outside and all(r["value"] is None for r in outside)
    assert resample(raster.limit(0), 1, 1, method).count() == 0
    with pytest.raises(ValueError):
        resample(raster, 1, 1, "other")
