"""The gravity pipeline: configuration, cached stages, cases, and the whole run from observations to the quasigeoid."""

from __future__ import annotations

import hashlib
import json
import time
import traceback
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from enum import Enum

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import gravity as G
from plumbline.operators import blocks, design, estimation, grids, lines, outliers, restore


class Case(Enum):
    """Prior variances (one or from a file) and regularisation (variance components or L-curve)."""

    UNIT_VC = ("unit", False)
    UNIT_VC_LC = ("unit", True)
    SIGMAS_VC = ("priors", False)
    SIGMAS_VC_LC = ("priors", True)

    @property
    def unit(self) -> bool:
        return self.value[0] == "unit"

    @property
    def l_curve(self) -> bool:
        return self.value[1]


@dataclass(frozen=True)
class Config:
    """Region, resolution and numerical settings of a run."""

    south: float
    north: float
    west: float
    east: float
    step: float
    order: int
    n_max: int
    n_min: int = 0
    kernel: str = "Shannon"
    aperture: float = 1.1
    half_width_km: float | None = 3.0
    spacing_m: float | None = None
    max_iter: int = 50
    tol: float = 1e-11
    sigma2_mu: float = 1.0
    cases: tuple[Case, ...] = (Case.UNIT_VC,)
    force: tuple[str, ...] = ()
    save_seconds: float = 5.0
    split: dict[str, bool] = field(default_factory=dict)


def fingerprint(frame: DataFrame | None) -> list[str]:
    """What tells one table's contents from another's, however they came about: columns and order-free sums of row hashes."""
    if frame is None:
        return []
    row = F.xxhash64(*frame.columns)
    sums = frame.select(row.alias("h"), F.xxhash64(F.lit(1), *frame.columns).alias("g")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("g").cast("decimal(38,0)"))).first()
    return [frame.schema.simpleString(), *map(str, sums)]


class StageCache:
    """Stages as Parquet under names that hold the settings and the contents of the inputs they came from: a changed region,
    resolution or table never meets an old result. force: stage names (or beginnings of them, or "all") to compute anew."""

    def __init__(self, spark: SparkSession, folder: str, force: tuple[str, ...] = ()) -> None:
        self.spark, self.folder, self.force = spark, folder.rstrip("/"), force
        self.log: list[tuple[str, str]] = []
        self.seconds: list[float] = []

    def forced(self, stage: str) -> bool:
        return any(f == "all" or stage.startswith(f) or f.startswith(stage) for f in self.force)

    def path(self, stage: str, settings: object) -> str:
        key = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.folder}/{stage}-{key}"

    def note(self, stage: str, outcome: str, began: float) -> None:
        self.log.append((stage, outcome))
        self.seconds.append(time.monotonic() - began)

    def has(self, stage: str, settings: object) -> bool:
        """Whether the stage would be kept."""
        return not self.forced(stage) and self._complete(self.path(stage, settings))

    def get(self, stage: str, settings: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows, from its files if they are complete."""
        began, path = time.monotonic(), self.path(stage, settings)
        if self.has(stage, settings):
            self.note(stage, "kept", began)
        else:
            make().write.mode("overwrite").parquet(path)
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}.done")  # last, so that it vouches for the rest
            self.note(stage, "made", began)
        return self.spark.read.parquet(path)

    def step(self, stage: str, settings: object, row: tuple, schema: str, first: bool) -> None:
        """Add a step of a stage that goes on from its last one; each step is there as a whole or not at all."""
        self.spark.createDataFrame([row], schema).write.mode("overwrite" if first else "append").parquet(self.path(stage, settings))

    def last_step(self, stage: str, settings: object, order: str, most: int) -> Row | None:
        """The last step (up to `most`) that a run before has left, if steps aren't forced."""
        if self.forced(stage):
            return None
        try:
            return self.spark.read.parquet(self.path(stage, settings)).where(F.col(order) <= most).orderBy(F.desc(order)).first()
        except AnalysisException:  # none yet
            return None

    def _complete(self, path: str) -> bool:
        try:
            return self.spark.read.parquet(f"{path}.done").count() == 1
        except AnalysisException:  # not there
            return False

    def report(self) -> DataFrame:
        """What became of the stages, in their order, and the seconds that each took."""
        rows = [(k, stage, outcome, s) for k, ((stage, outcome), s) in enumerate(zip(self.log, self.seconds, strict=True))]
        return self.spark.createDataFrame(rows, "step int, stage string, outcome string, seconds double")


def manifest(spark: SparkSession, sources: dict[str, bool]) -> DataFrame:
    """source and split: which observation sources get a variance component for each project."""
    return spark.createDataFrame(sorted(sources.items()), "source string, split boolean")


def reduce_airborne(obs: DataFrame, signal: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers) of flight lines: disturbance, filter, subsampling, removal, outliers. signal: obs_id, ggm,
    topo_high, topo_low. Each step hands its column on explicitly, whichever steps are on."""
    points = obs.withColumn("disturbance", G.disturbance(F.col("g"), F.col("lat"), F.col("h")))
    if config.half_width_km is not None:
        points = lines.gaussian_filter(points, config.half_width_km, "disturbance", "smooth").withColumn("disturbance", F.col("smooth")).drop("smooth")
    if config.spacing_m is not None:
        points = lines.distance_subsample(points, config.spacing_m).drop("step", "along")
    judged = outliers.detect(restore.remove_airborne(points.join(signal, "obs_id", "left")), "disturbance")
    return judged.where("NOT is_outlier"), judged.where("is_outlier")


def reduce_terrestrial(obs: DataFrame, signal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers) of stations; signal also has ertm."""
    points = obs.withColumn("disturbance", G.disturbance(F.col("g"), F.col("lat"), F.col("h")))
    judged = outliers.detect(restore.remove_terrestrial(points.join(signal, "obs_id", "left")), "disturbance")
    return judged.where("NOT is_outlier"), judged.where("is_outlier")


@dataclass
class Outcome:
    """What one case gives: pixels with all results, parameters with their significance, or the error that stopped it."""

    case: Case
    pixels: DataFrame | None = None
    parameters: DataFrame | None = None
    error: str | None = None
    iterations: int | None = None
    sigma2: dict[str, float] | None = None
    sigma2_mu: float | None = None
    lam: float | None = None


def summary(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """A row for each case: iterations, variances, regularisation parameter, error. A case taken whole from a run before has what
    that run wrote."""
    rows = [(o.case.name, o.iterations, o.sigma2, o.sigma2_mu, o.lam, o.error) for o in outcomes]
    return spark.createDataFrame(rows, "case string, iterations int, sigma2 map<string,double>, sigma2_mu double, lambda double, error string")


STATE = "iteration int, numbers string, beta binary"
CORNER = "lam double, numbers string, beta binary"
SYSTEM = "g string, n long, yy double, xx binary, xy binary, xu binary"


def _system_rows(spark: SparkSession, systems: dict[str, design.Normal]) -> DataFrame:
    """Dense systems as rows; DENSE_BYTES bounds them."""
    pack = lambda x: None if x is None else bytearray(np.ascontiguousarray(x).tobytes())
    return spark.createDataFrame([(g, s.n, s.yy, pack(s.xx), pack(s.xy), pack(s.xu)) for g, s in systems.items()], SYSTEM)


def _systems_of(rows: DataFrame, m: int) -> dict[str, design.Normal]:
    out = {}
    for r in rows.orderBy("g").collect():
        xx, xy, xu = (None if r[n] is None else np.frombuffer(r[n], float) for n in ("xx", "xy", "xu"))
        out[r["g"]] = design.Normal(r["n"], xx.reshape(m, m), xy, r["yy"], None if xu is None else xu.reshape(m, -1))
    return out


def run(spark: SparkSession, config: Config, sources: dict[str, DataFrame], pixel_fields: DataFrame, folder: str, priors: DataFrame | None = None) -> tuple[list[Outcome], StageCache]:
    """Estimate from reduced sources (obs_id, project, lat, lon, h, residual in mGal) and predict on the pixels.

    pixel_fields: pixel_id, lat, lon, srtm, height, model, topo, terrain. Cases share what they can: normal systems are
    computed once, variance components once for each kind of priors, the L-curve once for each kind. A case that fails
    leaves its error and the others go on.

    Everything is a stage that the next run keeps: systems (or the stored design), steps of the components (those after
    which `save_seconds` have gone by, and the last one), L-curves, each case's pixels, parameters and summary. A stage is
    made only where one that depends on it is, so a run over kept results computes none, and a stopped one goes on from its
    last step.
    """
    cache = StageCache(spark, folder, config.force)
    settings = asdict(config) | {"cases": None, "force": None, "save_seconds": None}
    box = {k: settings[k] for k in ("south", "north", "west", "east", "aperture", "order")}
    nodes = cache.get("nodes", box, lambda: grids.reuter_nodes(spark, config.order, config.south - config.aperture, config.north + config.aperture, config.west - config.aperture, config.east + config.aperture))
    basis = design.Basis.of(nodes, config.n_max, config.kernel, config.n_min)
    if not len(basis.node_id):
        raise ValueError(f"the grid of order {config.order} has no nodes in the region")
    parts = [estimation.group_by_project(obs, config.split.get(name, False), name).select("obs_id", "project", "lat", "lon", "h", (F.col("residual") / 1e5).alias("y"), "group_id") for name, obs in sorted(sources.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    seen = fingerprint(every)
    fields = fingerprint(pixel_fields) + fingerprint(priors)
    observations = cache.get("observations", {"sources": sorted(sources), "split": config.split, "rows": seen}, lambda: every)
    m = len(basis.node_id)
    plain = {k: settings[k] for k in (*box, "n_max", "n_min", "kernel")} | {"sources": sorted(sources), "split": config.split, "rows": seen}
    priors_seen = fingerprint(priors)
    made: dict[str, object] = {}

    def systems() -> dict[str, design.Normal] | blocks.BlockSystems:
        if "systems" not in made:
            groups = observations.select("group_id").distinct().count()
            if groups * m * m * 8 <= design.DENSE_BYTES:
                made["systems"] = _systems_of(cache.get("systems", plain, lambda: _system_rows(spark, design.normal_systems(observations, basis, n_probes=1))), m)
            else:
                fresh: dict[str, blocks.BlockSystems] = {}

                def stored() -> DataFrame:
                    fresh["of"] = blocks.BlockSystems.of(observations, basis, n_probes=1)
                    return fresh["of"].design

                # a chunk's column blocks must follow each other: they are read by task and chunk
                rows = cache.get("design", plain, stored)
                sums = cache.get("sums", plain, lambda: (fresh.get("of") or blocks.BlockSystems.of(observations, basis, n_probes=1)).sum_rows())
                made["systems"] = blocks.BlockSystems.kept(blocks.in_chunks(rows), sums, m)
        return made["systems"]

    def kind(unit: bool) -> str:
        return "unit" if unit else "priors"

    def about(unit: bool) -> dict:
        return plain | {"sigma2_mu": config.sigma2_mu, "tol": config.tol, "priors": None if unit else priors_seen}

    def components(unit: bool) -> estimation.Components:
        name = f"components_{kind(unit)}"
        if name not in made:
            start = {}
            if not unit and priors is not None:
                groups = observations.select(F.col("group_id").alias("project")).distinct()
                start = {r["project"]: r["sigma2"] for r in estimation.prior_sigmas(groups, priors).collect()}
            began, saved, steps = time.monotonic(), [time.monotonic()], []
            last = cache.last_step(name, about(unit), "iteration", config.max_iter)

            def after(state: estimation.State) -> None:
                if state.settled or state.iteration == config.max_iter or time.monotonic() - saved[0] >= config.save_seconds:
                    cache.step(name, about(unit), state.to_row(), STATE, not last and not steps)
                    steps.append(state.iteration)
                    saved[0] = time.monotonic()

            made[name] = estimation.estimate_components(systems(), start, config.sigma2_mu, max_iter=config.max_iter, tol=config.tol, begin=estimation.State.of_row(*last) if last else None, after=after)
            cache.note(name, f"from step {last['iteration']}" if last else "made", began)
        return made[name]

    def corner(unit: bool) -> estimation.Corner:
        name = f"lcurve_{kind(unit)}"
        if name not in made:
            fresh: list[estimation.Corner] = []

            def sweeps() -> DataFrame:
                fresh.append(estimation.l_curve(systems(), components(unit)))
                return spark.createDataFrame([fresh[0].to_row()], CORNER)

            row = cache.get(name, about(unit) | {"max_iter": config.max_iter}, sweeps).first()
            made[name] = fresh[0] if fresh else estimation.Corner.of_row(*row, systems(), components(unit))
        return made[name]

    def solve(case: Case) -> tuple[np.ndarray, estimation.DenseFactor | blocks.Solver, float]:
        """Coefficients, and factor and scale of their covariance."""
        if not case.l_curve:
            vc = components(case.unit)
            return vc.beta, vc.factor, 1.0
        found = corner(case.unit)
        return found.beta, found.factor, found.scale

    def predict(beta: np.ndarray, factor: estimation.DenseFactor | blocks.Solver, scale: float) -> DataFrame:
        """pixel_id, potential, std_potential."""
        at = pixel_fields.select("pixel_id", "lat", "lon", F.col("height").alias("h"))
        if isinstance(factor, blocks.Solver):
            return design.synthesise(at, basis, beta, "pixel_id").join(factor.deviations(at, basis, "pixel_id", scale), "pixel_id")
        values, vectors = np.linalg.eigh(scale * factor.inverse())
        return design.synthesise(at, basis, beta, "pixel_id", vectors * np.sqrt(np.maximum(values, 0)))

    def case_of(case: Case) -> Outcome:
        name, own = case.name.lower(), settings | {"rows": seen, "fields": fields, "save_seconds": None}

        def pixels() -> DataFrame:
            restored = restore.restore(pixel_fields.join(predict(*solve(case)), "pixel_id"))
            return restore.zero_degree(restore.uncertainty(restored))

        def coefficients() -> DataFrame:
            beta, factor, scale = solve(case)
            rows = [(int(i), float(b), float(v)) for i, b, v in zip(basis.node_id, beta, scale * factor.diagonal(), strict=True)]
            table = spark.createDataFrame(rows, "node_id long, beta double, variance double")
            n_obs = sum(s.n for s in (systems() if isinstance(systems(), dict) else systems().sums).values())
            named = nodes.join(table, "node_id")
            return named.join(estimation.significance(table, n_obs), "node_id") if n_obs > len(rows) else named

        def told() -> DataFrame:
            vc = components(case.unit)
            return spark.createDataFrame([(vc.iterations, vc.sigma2, vc.sigma2_mu, corner(case.unit).lam if case.l_curve else None)], "iterations int, sigma2 map<string,double>, sigma2_mu double, lam double")

        done = Outcome(case, cache.get(f"pixels_{name}", own, pixels), cache.get(f"parameters_{name}", own, coefficients))
        r = cache.get(f"summary_{name}", own, told).first()
        done.iterations, done.sigma2, done.sigma2_mu, done.lam = r["iterations"], r["sigma2"], r["sigma2_mu"], r["lam"]
        return done

    outcomes = []
    for case in config.cases:
        try:
            outcomes.append(case_of(case))
        except Exception:  # the next case goes on
            outcomes.append(Outcome(case, error=traceback.format_exc()))
    return outcomes, cache
