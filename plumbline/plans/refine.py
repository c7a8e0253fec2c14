"""One call from files to the quasigeoid: observations, models and tiles in, what each case gives out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.operators import grids, harmonics, restore
from plumbline.plans import pipeline
from plumbline.roles import ColumnRoles
from plumbline.session import settle
from plumbline.sources import sinks, text, tiles


@dataclass(frozen=True)
class Inputs:
    """Where everything lies. Models are `.gfc` files; `topo_degrees` are the degrees between which the topographic model is the
    short-wave part; terrain tiles lie in one folder (`.dg` for disturbances in mGal, `.ha` for height anomalies). Each model has its
    own GM and radius; None takes them from the file's header. `marine` is a source (altimetry) whose terrain isn't
    modelled: it is neither filtered nor sampled, and residual terrain isn't taken off."""

    field_model: str
    field_degree: int
    topo_model: str
    topo_degrees: tuple[int, int]
    geoid_model: str
    geoid_degree: int
    elevation: str
    cells_per_degree: int
    terrain: str
    terrain_cells: int = tiles.CELLS
    terrestrial: str | None = None
    terrestrial_roles: ColumnRoles | None = None
    airborne: str | None = None
    airborne_roles: ColumnRoles | None = None
    marine: str | None = None
    marine_roles: ColumnRoles | None = None
    field_constants: tuple[float, float] | None = (C.MODEL_GM, C.MODEL_RADIUS)
    topo_constants: tuple[float, float] | None = (C.TOPO_GM, C.TOPO_RADIUS)
    geoid_constants: tuple[float, float] | None = (C.MODEL_GM, C.MODEL_RADIUS)
    priors: str | None = None


def observations(spark: SparkSession, path: str, roles: ColumnRoles, name: str) -> DataFrame:
    """obs_id, project, line, seq, lat, lon, h, g of a tab-separated table; rows without a position or value are left out.
    Without a key rows are numbered; seq is the order of the file."""
    found = roles.apply(text.read_table(spark, path)).withColumn("seq", F.monotonically_increasing_id())
    if "obs_id" not in found.columns:
        found = found.withColumn("obs_id", F.col("seq"))
    for column, kind, default in (("project", "string", name), ("line", "long", 0)):
        if column not in found.columns:
            found = found.withColumn(column, F.lit(default).cast(kind))
    return settle(found.dropna(subset=["lat", "lon", "h", "g"]).select("obs_id", "project", "line", "seq", "lat", "lon", "h", "g"))


def box_of(points: DataFrame) -> tiles.Box | None:
    """Borders of the points; None without points."""
    r = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    return None if r[0] is None else tuple(r)


def terrain_at(points: DataFrame, inputs: Inputs, kind: str, key: str, name: str) -> DataFrame:
    """The points with the residual terrain's bilinear value, 0 outside the tiles."""
    spark = points.sparkSession
    unit = 5 * tiles.UNITS_PER_DEGREE // inputs.terrain_cells
    step = unit / tiles.UNITS_PER_DEGREE
    cells = tiles.read_terrain_tiles(spark, inputs.terrain, kind, inputs.terrain_cells, box=box_of(points))
    grid = cells.select(F.floor(F.col("ilat") / unit).cast("int").alias("r"), F.floor(F.col("ilon") / unit).cast("int").alias("c"), "value")
    return grids.bilinear(points, grid, key, step / 2, step / 2, step, "zero", name)


def constants_of(spark: SparkSession, model: str, given: tuple[float, float] | None) -> dict[str, float]:
    gm, radius = text.gfc_constants(spark, model) if given is None else given
    return {"gm": gm, "radius": radius}


def signal(points: DataFrame, inputs: Inputs, key: str, functional: str) -> dict[str, DataFrame]:
    """key and value of the field model (less the normal field) and of the topographic model up to both its degrees, each with its
    own GM and radius."""
    spark = points.sparkSession
    field, topo = text.read_gfc(spark, inputs.field_model), text.read_gfc(spark, inputs.topo_model)
    of_field, of_topo = constants_of(spark, inputs.field_model, inputs.field_constants), constants_of(spark, inputs.topo_model, inputs.topo_constants)
    low, high = inputs.topo_degrees
    made = {"ggm": harmonics.synthesis(points, field, inputs.field_degree, 2, functional, subtract_normal=True, key=key, **of_field)}
    return made | {name: harmonics.synthesis(points, topo, degree, 0, functional, key=key, **of_topo) for name, degree in (("topo_low", low), ("topo_high", high))}


def pixel_fields(spark: SparkSession, config: pipeline.Config, inputs: Inputs) -> DataFrame:
    """pixel_id, lat, lon, srtm, height, model, topo, terrain of the region's pixels; no elevation counts as sea."""
    pixels = grids.pixel_centres(spark, config.south, config.north, config.west, config.east, config.step).select("pixel_id", "lat", "lon")
    box = (config.south, config.north, config.west, config.east)
    elevated = grids.sample_elevation(pixels, tiles.read_hgt(spark, inputs.elevation, box), "pixel_id", inputs.cells_per_degree, name="srtm").withColumn("srtm", F.coalesce("srtm", F.lit(0e0)))
    geoid = harmonics.geoid_grid(pixels, text.read_gfc(spark, inputs.geoid_model), inputs.geoid_degree, n_min=2, subtract_normal=True, **constants_of(spark, inputs.geoid_model, inputs.geoid_constants))
    placed = settle(elevated.join(geoid.select("pixel_id", "undulation"), "pixel_id").withColumn("height", F.col("srtm") + F.col("undulation")))
    found = restore.attach(placed, "pixel_id", **signal(placed.withColumn("h", F.col("height")), inputs, "pixel_id", "potential"))
    found = terrain_at(found, inputs, "ha", "pixel_id", "terrain")
    return settle(found.select("pixel_id", "lat", "lon", "srtm", "height", F.col("ggm").alias("model"), (F.col("topo_high") - F.col("topo_low")).alias("topo"), "terrain"))


#: Columns of the written tables of reduced observations: place, height, disturbance, the models' parts and what is left.
REDUCED = ("lat", "lon", "h", "disturbance", "ertm", "ggm", "topo", "less_ggm", "residual")


def write_reduced(name: str, clean: DataFrame, outliers: DataFrame, folder: str) -> None:
    """Tab-separated tables of a source's reduced observations and of its outliers, under the run's folder."""
    for kind, frame in (("reduced", clean), ("outliers", outliers)):
        sinks.write_table(frame.select(*(c for c in REDUCED if c in frame.columns)), f"{folder.rstrip('/')}/{kind}_{name}.txt")


def refine(spark: SparkSession, config: pipeline.Config, inputs: Inputs, folder: str) -> tuple[list[pipeline.Outcome], pipeline.StageCache, dict[str, DataFrame]]:
    """(what each case gives, the stages' log, outliers of each source) from the files that `inputs` names."""
    sources, outliers = {}, {}
    if inputs.terrestrial is not None:
        points = observations(spark, inputs.terrestrial, inputs.terrestrial_roles, "terrestrial")
        tables = signal(points, inputs, "obs_id", "disturbance") | {"ertm": terrain_at(points, inputs, "dg", "obs_id", "value").select("obs_id", "value")}
        sources["terrestrial"], outliers["terrestrial"] = pipeline.reduce_terrestrial(points, restore.attach(points.select("obs_id"), "obs_id", **tables))
    if inputs.airborne is not None:
        points = observations(spark, inputs.airborne, inputs.airborne_roles, "airborne")
        tables = signal(points, inputs, "obs_id", "disturbance")
        sources["airborne"], outliers["airborne"] = pipeline.reduce_airborne(points, restore.attach(points.select("obs_id"), "obs_id", **tables), config)
    if inputs.marine is not None:
        points = observations(spark, inputs.marine, inputs.marine_roles, "marine")
        tables = signal(points, inputs, "obs_id", "disturbance")
        plain = replace(config, half_width_km=None, spacing_m=None)
        sources["marine"], outliers["marine"] = pipeline.reduce_airborne(points, restore.attach(points.select("obs_id"), "obs_id", **tables), plain)
    sources = {name: settle(frame) for name, frame in sources.items()}
    outliers = {name: settle(frame) for name, frame in outliers.items()}
    for name, frame in sources.items():
        write_reduced(name, frame, outliers[name], folder)
    priors = text.read_priors(spark, inputs.priors) if inputs.priors else None
    outcomes, cache = pipeline.run(spark, config, sources, pixel_fields(spark, config, inputs), folder, priors)
    return outcomes, cache, outliers
