import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.operators import restore
from plumbline.plans import pipeline
from plumbline.plans.views import view
from plumbline.roles import MissingColumnsError
from plumbline.sources import sinks, text, tiles
from plumbline.streaming import ingest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def put(path, content, mode="w"):
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(content)
    return str(path)


def test_tables(spark, tmp_path):
    p = put(tmp_path / "a.txt", "﻿lat\tlon\tname\n36.5\tx\ta\n 1\t2\tb\n")
    rows = text.read_table(spark, p, numbers=["lat", "lon"]).collect()
    assert [tuple(r) for r in rows] == [(36.5, None, "a"), (1.0, 2.0, "b")]
    with pytest.raises(MissingColumnsError):
        text.read_table(spark, p, numbers=["nope"])
    assert text.read_synthesis(spark, put(tmp_path / "b.txt", "  1 2   3 4\n5 6 7 bad\n\n")).collect()[1]["value"] is None
    assert text.read_sniffed(spark, put(tmp_path / "c.txt", "a,b\n1,2\n"), ["a"]).first()["a"] == 1.0
    assert [tuple(r) for r in text.read_sniffed(spark, put(tmp_path / "d.txt", "a b\n1 2\n")).collect()] == [(1.0, 2.0)]
    assert text.read_undulations(spark, put(tmp_path / "e.txt", "1 2 3\n")).first()["undulation"] == 3.0
    assert [r["value"] for r in text.read_vector(spark, put(tmp_path / "f.txt", "3e0\n1e0\n2e0\n")).orderBy("i").collect()] == [3.0, 1.0, 2.0]
    (tmp_path / "v").mkdir()
    for k in range(3):
        put(tmp_path / "v" / f"{k}.txt", "".join(f"{k * 100 + i}\n" for i in range(40)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60b")  # files in several blocks, dealt in any order
        assert [(r["i"], r["value"]) for r in text.read_vector(spark, str(tmp_path / "v")).orderBy("i").collect()] == [(k * 40 + i + 1, float(k * 100 + i)) for k in range(3) for i in range(40)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert text.read_weights(spark, put(tmp_path / "g.csv", "1.5,2\n3,4\n")).columns == ["w0", "w1"]
    assert [tuple(r) for r in text.read_priors(spark, put(tmp_path / "h.txt", "Block A\t2.5\nB 3\n")).collect()] == [("Block A", 2.5), ("B", 3.0)]
    assert [r["split"] for r in text.read_manifest(spark, put(tmp_path / "i.txt", "a\tb\tSi\nc\td\tNo\n")).collect()] == [True, False]
    model = text.read_gfc(spark, put(tmp_path / "m.gfc", "product x\nend_of_head ===\ngfc 2 0 -4.8D-04 0.0 1 1\ngfc 2 1 1e-10 2e-10\n")).collect()
    assert [tuple(r) for r in model] == [(2, 0, -4.8e-4, 0.0), (2, 1, 1e-10, 2e-10)]


def test_tiles(spark, tmp_path):
    z = np.arange(16, dtype=">i2").reshape(4, 4)
    z[0, 0] = -32768
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "N05W075.dg", z.tobytes(), "wb")
    rows = {(r["ilat"], r["ilon"]): r["value"] for r in tiles.read_terrain_tiles(spark, str(tmp_path / "t"), "dg", cells=4).collect()}
    unit = 5 * tiles.UNITS_PER_DEGREE // 4
    assert len(rows) == 15 and rows[(10 * tiles.UNITS_PER_DEGREE - unit // 2 - unit, -75 * tiles.UNITS_PER_DEGREE + unit // 2)] == 0.1
    h = np.array([[5, -3], [-32768, 7]], ">i2")
    put(tmp_path / "t" / "S01E010.hgt", h.tobytes(), "wb")
    assert sorted(tuple(r) for r in tiles.read_hgt(spark, str(tmp_path / "t")).collect()) == [(-1.0, 11.0, 7.0), (0.0, 10.0, 5.0), (0.0, 11.0, 0.0)]
    for order in "CF":
        np.save(tmp_path / f"x{order}.npy", np.asarray(np.arange(6.0).reshape(3, 2), order=order))
        assert [list(r["values"]) for r in tiles.read_npy(spark, str(tmp_path / f"x{order}.npy")).orderBy("row_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    names = spark.createDataFrame([("EGM2008",), ("XGM2019e_2159",), ("XGM2019e",), ("GOCO06s",)], "name string")
    assert tiles.choose_model(names, "xgm2019e").first()["name"] == "XGM2019e"
    assert tiles.choose_model(names, "xgm2019", 2159).first()["name"] == "XGM2019e_2159"
    index = spark.createDataFrame([("N05W075.dg",), ("S10W075.dg",), ("readme",)], "name string")
    assert [r["name"] for r in tiles.tiles_needed(index, 4, 6, -76, -74).collect()] == ["N05W075.dg"]
    assert tiles.missing_tiles(index, index.limit(2)).count() == 1


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(2.0, 1.0, 5.0), (1.0, 2.0, 6.0), (1.0, 1.0, 7.0)], "lat double, lon double, value double")
    sinks.write_stage(p, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    sinks.write_table(p, str(tmp_path / "t"), 3)
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).where("value = '5.000'").count() == 1
    sinks.write_points(p.withColumn("h", F.lit(0.0)), str(tmp_path / "p"))
    sinks.write_grid(p, str(tmp_path / "g"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "g")).collect()) == ["0 5.0 -99999.0", "1 7.0 6.0"]
    assert sinks.report_lines(p.limit(1)).count() == 1


def test_pipeline_cases_and_cache(spark, tmp_path):
    obs = view(spark, DATA, "obs_ter")
    clean, bad = pipeline.reduce_terrestrial(obs, view(spark, DATA, "model_signal"))
    assert clean.count() + bad.count() == obs.count()
    config = pipeline.Config(36.5, 38.5, -108.5, -103.5, 0.5, 40, 20, aperture=0.5, sigma2_mu=1e6, max_iter=5, cases=tuple(pipeline.Case))
    pixels = pipeline.grids.pixel_centres(spark, 36.5, 38.5, -108.5, -103.5, 0.5).select("pixel_id", "lat", "lon", F.lit(1000.0).alias("srtm"), F.lit(1010.0).alias("height"), *(F.lit(0.0).alias(c) for c in ("model", "topo", "terrain")))
    priors = spark.createDataFrame([("ter", 2.0)], "project string, sigma2 double")
    outcomes, cache = pipeline.run(spark, config, {"ter": clean}, pixels, str(tmp_path / "run"), priors)
    assert [o.error for o in outcomes] == [None] * 4
    assert all(o.pixels.where("zeta_final IS NULL OR std_zeta IS NULL").count() == 0 and o.pixels.count() == 40 for o in outcomes)
    assert cache.log[0] == ("nodes", "made")
    again = pipeline.StageCache(spark, str(tmp_path / "run"))
    settings = {"south": 36.5, "north": 38.5, "west": -108.5, "east": -103.5, "aperture": 0.5, "order": 40}
    again.get("nodes", settings, lambda: pytest.fail("should be kept"))
    forced = pipeline.StageCache(spark, str(tmp_path / "run"), ("nod",))
    forced.get("nodes", settings, lambda: spark.range(1))
    assert again.log == [("nodes", "kept")] and forced.report().first()["outcome"] == "made"


def small_run(spark, tmp_path, **changed):
    options = {"aperture": 0.5, "sigma2_mu": 1e6, "max_iter": 6, "tol": 0.0, "save_seconds": 0.0, "cases": (pipeline.Case.UNIT_VC, pipeline.Case.UNIT_VC_LC)} | changed
    config = pipeline.Config(36.5, 38.5, -108.5, -103.5, 0.5, 40, 10, **options)
    pixels = pipeline.grids.pixel_centres(spark, 36.5, 38.5, -108.5, -103.5, 0.5).select("pixel_id", "lat", "lon", F.lit(1000.0).alias("srtm"), F.lit(1010.0).alias("height"), *(F.lit(0.0).alias(c) for c in ("model", "topo", "terrain")))
    obs = view(spark, DATA, "obs_ter").withColumn("residual", F.col("g") - 9795e2)
    return pipeline.run(spark, config, {"ter": obs}, pixels, str(tmp_path / "run"))


@pytest.mark.parametrize("dense", [True, False])
def test_second_run_computes_nothing(spark, tmp_path, monkeypatch, dense):
    """Systems, components, sweeps, pixels and parameters are kept; without its pixels a case takes them from the stages before."""
    if not dense:
        monkeypatch.setattr(pipeline.design, "DENSE_BYTES", 1)
    first, cache = small_run(spark, tmp_path)
    assert [o.error for o in first] == [None, None]
    stages = dict(cache.log)
    assert stages["systems" if dense else "design"] == "made" and stages["components_unit"] == "made" and stages["lcurve_unit"] == "made"
    report = cache.report().collect()
    assert [r["stage"] for r in report] == [s for s, _ in cache.log] and all(r["seconds"] >= 0 for r in report)
    fail = lambda *a, **b: pytest.fail("computed again")
    for owner, name in ((pipeline.design, "normal_systems"), (pipeline.blocks.BlockSystems, "of"), (pipeline.estimation, "l_curve"), (pipeline.design, "synthesise")):
        monkeypatch.setattr(owner, name, fail)
    monkeypatch.setattr(pipeline.estimation, "estimate_components", fail)
    second, cache = small_run(spark, tmp_path)
    assert [o.error for o in second] == [None, None] and {o for _, o in cache.log} == {"kept"}
    for a, b in zip(first, second):
        assert (a.iterations, a.sigma2, a.sigma2_mu, a.lam) == (b.iterations, b.sigma2, b.sigma2_mu, b.lam) and a.iterations == 6
        assert a.pixels.exceptAll(b.pixels).count() == 0 and a.parameters.exceptAll(b.parameters).count() == 0
    rows = {r["case"]: r for r in pipeline.summary(spark, second).collect()}
    assert rows["UNIT_VC"]["iterations"] == 6 and rows["UNIT_VC"]["lambda"] is None and rows["UNIT_VC_LC"]["lambda"] > 0


def test_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    """A run that stops in its fourth step: the next one begins with the fourth, and ends as one that was never stopped."""
    whole, _ = small_run(spark, tmp_path / "whole", cases=(pipeline.Case.UNIT_VC,))
    real, calls = pipeline.estimation.DenseSystems.factor, []

    def factor(self, *a):
        calls.append(a)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return real(self, *a)

    monkeypatch.setattr(pipeline.estimation.DenseSystems, "factor", factor)
    with pytest.raises(KeyboardInterrupt):
        small_run(spark, tmp_path, cases=(pipeline.Case.UNIT_VC,))
    before = len(calls)
    (outcome,), cache = small_run(spark, tmp_path, cases=(pipeline.Case.UNIT_VC,))
    assert outcome.error is None and len(calls) - before == 3 and ("components_unit", "from step 3") in cache.log and ("systems", "kept") in cache.log
    assert outcome.sigma2 == pytest.approx(whole[0].sigma2, rel=1e-12)
    forced, cache = small_run(spark, tmp_path, cases=(pipeline.Case.UNIT_VC,), force=("components", "pixels", "parameters", "summary"))
    assert forced[0].error is None and dict(cache.log)["components_unit"] == "made"


def test_changed_inputs_are_never_kept(spark, tmp_path):
    """Observations changed in place, pixel fields and priors: each is seen although every plan stays the same."""
    config = pipeline.Config(36.5, 38.5, -108.5, -103.5, 0.5, 40, 10, aperture=0.5, sigma2_mu=1e6, max_iter=2, cases=(pipeline.Case.SIGMAS_VC,))
    box = pipeline.grids.pixel_centres(spark, 36.5, 38.5, -108.5, -103.5, 0.5).select("pixel_id", "lat", "lon", F.lit(1000.0).alias("srtm"), F.lit(1010.0).alias("height"), *(F.lit(0.0).alias(c) for c in ("model", "topo", "terrain")))
    tables = {"obs": view(spark, DATA, "obs_ter").withColumn("residual", F.col("g") - 9795e2), "pixels": box, "priors": spark.createDataFrame([("ter", 2.0)], "project string, sigma2 double")}

    def outcome(**changed):
        for name, frame in (tables | changed if not changed else changed).items():
            frame.write.mode("overwrite").parquet(str(tmp_path / name))
        spark.catalog.clearCache()
        obs, pixels, priors = (spark.read.parquet(str(tmp_path / n)) for n in ("obs", "pixels", "priors"))
        outcomes, cache = pipeline.run(spark, config, {"ter": obs}, pixels, str(tmp_path / "run"), priors)
        assert outcomes[0].error is None, outcomes[0].error
        return dict(cache.log)["pixels_sigmas_vc"], outcomes[0].pixels.agg(F.avg("zeta")).first()[0]

    first = outcome()
    assert first[0] == "made" and outcome(priors=tables["priors"]) == ("kept", first[1])
    raised = outcome(pixels=box.withColumn("terrain", F.lit(50.0)))
    assert raised[0] == "made" and raised[1] == pytest.approx(first[1] + 50, abs=0.01)
    assert outcome(pixels=box) == ("kept", first[1])
    assert outcome(priors=spark.createDataFrame([("ter", 3.0)], "project string, sigma2 double"))[0] == "made"
    assert outcome(obs=tables["obs"].withColumn("residual", F.col("residual") * 2))[0] == "made"


def test_from_files_to_quasigeoid(spark, tmp_path):
    """One call over written files; the pixels' fields equal what the operators give at these places."""
    import numpy as np

    from plumbline.operators import harmonics
    from plumbline.plans import refine
    from plumbline.roles import ColumnRoles

    rows = view(spark, DATA, "obs_ter").select("lat", "lon", "h", "g").collect()
    put(tmp_path / "ter.txt", "latitude\tlongitude\th\tgravity\n" + "".join(f"{r['lat']!r}\t{r['lon']!r}\t{r['h']!r}\t{r['g']!r}\n" for r in rows) + "bad\t1\t2\t3\n")
    rows = view(spark, DATA, "obs_air").select("lat", "lon", "h", "g", "line", "project").limit(300).collect()
    put(tmp_path / "air.txt", "lat(deg)\tlon(deg)\th\tg\tline\tblock\n" + "".join(f"{r['lat']!r}\t{r['lon']!r}\t{r['h']!r}\t{r['g']!r}\t{r['line']}\t{r['project']}\n" for r in rows))
    put(tmp_path / "sea.txt", "Lat\tLon\th\tanomaly\n" + "".join(f"{36 + k / 100!r}\t{-108 + k / 90!r}\t0.0\t{979_700 + k % 7!r}\n" for k in range(60)))
    head = "earth_gravity_constant 0.3986004415E+15\nradius 6378136.3\nend_of_head ===\n"
    model = put(tmp_path / "m.gfc", head + "gfc 2 0 -0.48416e-03 0.0\ngfc 2 1 1e-9 2e-9\ngfc 2 2 2.4e-6 -1.4e-6\ngfc 3 1 2.0e-6 2.5e-7\n")
    topo = put(tmp_path / "t.gfc", head + "gfc 2 0 1e-8 0.0\ngfc 4 2 1e-8 -2e-8\n")
    (tmp_path / "srtm").mkdir()
    (tmp_path / "ertm").mkdir()
    for lon in (109, 108):
        put(tmp_path / "srtm" / f"N36W{lon}.hgt", np.full((13, 13), 700, ">i2").tobytes(), "wb")
    for kind in ("dg", "ha"):
        put(tmp_path / "ertm" / f"N35W110.{kind}", np.full((50, 50), 20, ">i2").tobytes(), "wb")
        put(tmp_path / "ertm" / f"S05E020.{kind}", b"cut off", "wb")  # outside of the region: never opened
    put(tmp_path / "srtm" / "S05E020.hgt", b"cut off!", "wb")
    priors = put(tmp_path / "priors.txt", "terrestrial\t2.0\n")
    config = pipeline.Config(36.0, 37.0, -109.0, -107.0, 0.25, 150, 20, aperture=0.5, sigma2_mu=1e6, max_iter=2, cases=(pipeline.Case.SIGMAS_VC,))
    inputs = refine.Inputs(model, 3, topo, (2, 4), model, 3, str(tmp_path / "srtm"), 12, str(tmp_path / "ertm"), 50, str(tmp_path / "ter.txt"), ColumnRoles("latitude", "longitude", "h", "gravity"), str(tmp_path / "air.txt"), ColumnRoles("lat(deg)", "lon(deg)", "h", "g", project="block", line="line"), str(tmp_path / "sea.txt"), ColumnRoles("Lat", "Lon", "h", "anomaly"), priors=priors)
    (outcome,), cache, outliers = refine.refine(spark, config, inputs, str(tmp_path / "run"))
    assert outcome.error is None, outcome.error
    pixels = outcome.pixels.collect()
    assert len(pixels) == 4 * 8 and set(outliers) == {"terrestrial", "airborne", "marine"} and ("pixels_sigmas_vc", "made") in cache.log
    potential = {r["pixel_id"]: r["value"] for r in harmonics.synthesis(outcome.pixels.select("pixel_id", "lat", "lon", F.col("height").alias("h")), text.read_gfc(spark, model), 3, 2, "potential", subtract_normal=True, key="pixel_id").collect()}
    at = outcome.pixels.select("pixel_id", "lat", "lon", F.col("height").alias("h"))
    low, high = ({r["pixel_id"]: r["value"] for r in harmonics.synthesis(at, text.read_gfc(spark, topo), n, 0, "potential", C.TOPO_GM, C.TOPO_RADIUS, key="pixel_id").collect()} for n in (2, 4))
    assert all(r["topo"] == pytest.approx(high[r["pixel_id"]] - low[r["pixel_id"]], rel=1e-12) for r in pixels)
    other = {r["pixel_id"]: r["value"] for r in harmonics.synthesis(at, text.read_gfc(spark, topo), 4, 0, "potential", key="pixel_id").collect()}
    assert any(abs(high[k] - other[k]) > 1e-9 * abs(high[k]) for k in high)  # the models' constants aren't the same
    for name, columns in (("terrestrial", refine.REDUCED), ("airborne", [c for c in refine.REDUCED if c != "ertm"]), ("marine", [c for c in refine.REDUCED if c != "ertm"])):
        tables = {kind: text.read_table(spark, str(tmp_path / "run" / f"{kind}_{name}.txt"), numbers=list(columns)) for kind in ("reduced", "outliers")}
        assert tables["reduced"].columns == list(columns) and tables["outliers"].count() == outliers[name].count()
        left = F.col("disturbance") - F.col("ggm") - F.col("topo") - (F.col("ertm") if name == "terrestrial" else 0)
        assert tables["reduced"].count() > 0 and tables["reduced"].where(F.abs(F.col("residual") - left) > 1e-6).count() == 0
    for r in pixels:
        assert r["srtm"] == pytest.approx(700) and r["terrain"] == pytest.approx(0.02) and r["model"] == pytest.approx(potential[r["pixel_id"]])
        assert r["zeta"] is not None and r["std_zeta"] is not None and abs(r["height"] - 700) < 200


def test_constants_of_models(spark, tmp_path):
    path = put(tmp_path / "a.gfc", "modelname x\nearth_gravity_constant 0.3986005D+15\nradius 0.63781370E+07\nend_of_head\ngfc 2 0 1e-3 0\n")
    assert text.gfc_constants(spark, path) == (3.986005e14, 6378137.0)
    with pytest.raises(ValueError, match="names no radius"):
        text.gfc_constants(spark, put(tmp_path / "b.gfc", "earth_gravity_constant 1e14\nend_of_head\n"))


def test_boxes_of_tiles(spark, tmp_path):
    """Cells in the box equal those of an unpruned read, and tiles outside of it aren't opened."""
    import numpy as np

    rng = np.random.default_rng(2)
    for lat, lon in ((0, 0), (0, 5), (5, 0), (-5, -5)):
        name = f"{'N' if lat >= 0 else 'S'}{abs(lat):02}{'E' if lon >= 0 else 'W'}{abs(lon):03}"
        put(tmp_path / f"{name}.dg", rng.integers(-50, 50, (50, 50)).astype(">i2").tobytes(), "wb")
        put(tmp_path / f"{name}.hgt", rng.integers(0, 500, (13, 13)).astype(">i2").tobytes(), "wb")
    box = (-0.5, 5.7, -1.0, 6.0)
    every, some = (tiles.read_terrain_tiles(spark, str(tmp_path), "dg", 50, box=b) for b in (None, box))
    units = [round(x * tiles.UNITS_PER_DEGREE) for x in box]
    inside = every.where(F.col("ilat").between(units[0], units[1]) & F.col("ilon").between(units[2], units[3]))
    assert inside.exceptAll(some).count() == 0 and 0 < some.count() < every.count() and some.exceptAll(every).count() == 0
    inside = tiles.read_hgt(spark, str(tmp_path)).where(F.col("lat").between(0, 0.5) & F.col("lon").between(5.2, 5.6))
    some = tiles.read_hgt(spark, str(tmp_path), (0, 0.5, 5.2, 5.6))
    assert inside.exceptAll(some).count() == 0 and some.count() < 13 * 13
    put(tmp_path / "N60E060.dg", b"x", "wb")
    assert tiles.read_terrain_tiles(spark, str(tmp_path), "dg", 50, box=box).count() > 0
    assert tiles.read_terrain_tiles(spark, str(tmp_path), "dg", 50, box=(80, 81, 80, 81)).count() == 0
    assert tiles.tile_listing(spark, str(tmp_path), "dg").count() == 5


def test_failing_case_is_isolated(spark, tmp_path):
    clean = view(spark, DATA, "obs_ter").withColumn("residual", F.lit(1.0))
    config = pipeline.Config(36.5, 38.5, -108.5, -103.5, 0.5, 40, 10, aperture=0.5, cases=(pipeline.Case.UNIT_VC,))
    outcomes, _ = pipeline.run(spark, config, {"ter": clean}, spark.createDataFrame([(0, 1.0)], "pixel_id long, lat double"), str(tmp_path / "bad"))
    assert outcomes[0].error is not None


def test_airborne_reduction(spark):
    obs = view(spark, DATA, "obs_air")
    signal = obs.select("obs_id", F.lit(0.0).alias("ggm"), F.lit(0.0).alias("topo_high"), F.lit(0.0).alias("topo_low"))
    config = pipeline.Config(36, 37, -109, -108, 0.5, 10, 5, half_width_km=3.0, spacing_m=2500.0)
    clean, bad = pipeline.reduce_airborne(obs, signal, config)
    assert 0 < clean.count() + bad.count() < obs.count()


def test_attach_is_by_key(spark):
    points = spark.createDataFrame([(1,), (2,)], "obs_id long")
    values = spark.createDataFrame([(2, 20.0), (1, 10.0)], "obs_id long, value double")
    assert {r["obs_id"]: r["ggm"] for r in restore.attach(points, "obs_id", ggm=values).collect()} == {1: 10.0, 2: 20.0}


def test_stream(spark, tmp_path):
    view(spark, DATA, "obs_air").limit(20).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.write_disturbances(spark, str(tmp_path / "in"), str(tmp_path / "out"), "test").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("disturbance IS NOT NULL").count() == 20


def test_geotiff(spark, tmp_path):
    from plumbline.sources import geotiff

    values = np.array([[1.5, 2.5, -99999.0], [4.0, 5.0, 6.0]])
    got, west, north, sx, sy, nodata = geotiff.decode(geotiff.encode(values, -74.0, 5.0, 0.5, 0.25) + b"\n")
    assert (got == values).all() and (west, north, sx, sy, nodata) == (-74.0, 5.0, 0.5, 0.25, -99999.0)
    p = spark.createDataFrame([(2.0, 1.0, 5.0), (1.0, 2.0, 6.0), (1.0, 1.0, 7.0)], "lat double, lon double, value double")
    for single in (False, True):
        target = str(tmp_path / "a.tif")
        geotiff.write_geotiff(p, target, single=single)
        back = {(r["lat"], r["lon"]): r["value"] for r in geotiff.read_geotiff(spark, target).collect()}
        assert back == {(2.0, 1.0): 5.0, (1.0, 2.0): 6.0, (1.0, 1.0): 7.0}
    with pytest.raises(ValueError):
        geotiff.write_geotiff(p.limit(0), str(tmp_path / "b.tif"))


def test_lzw():
    from plumbline.sources import geotiff

    def pack(codes):
        table, bits, out, last = 258, "", bytearray(), None
        for c in codes:
            width = min(12, max(9, (table + 1).bit_length()))
            bits += format(c, f"0{width}b")
            if c == 256:
                table, last = 258, None
            elif c != 257:
                table += last is not None
                last = c
        bits += "0" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            out.append(int(bits[k : k + 8], 2))
        return bytes(out)

    assert geotiff._lzw(pack([256, 7, 258, 8, 8, 258, 6, 257])) == bytes([7, 7, 7, 8, 8, 7, 7, 6])


def test_settling_keeps_settings(spark):
    from plumbline.session import FILES_GO, settle

    before = spark.conf.get(FILES_GO)
    rows = settle(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(FILES_GO) == before and rows.count() == 7 and rows.agg(F.sum("count")).first()[0] == 1000
