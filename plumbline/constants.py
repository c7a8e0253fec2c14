"""Physical constants. They are fixed values and deliberately not all consistent with each other."""

# Normal gravity at the equator and at the poles, mGal; ellipsoid axes, m; flattening; m = omega^2 a^2 b / GM.
GAMMA_EQUATOR, GAMMA_POLE = 978032.67715, 983218.63685
AXIS_A, AXIS_B = 6378137.0, 6356752.3141
FLATTENING, CENTRIFUGAL = 0.00335281068118, 0.00344978600308
#: The minor axis that the design kernel uses.
KERNEL_AXIS_B = 6356752.314140356
#: Normal and actual potential of the zero-degree term, m^2/s^2.
U0, W0 = 62636860.850, 62636853.4
#: GM and radius of the geopotential model and of the topographic model.
MODEL_GM, MODEL_RADIUS = 3986004.415e8, 6378136.3
TOPO_GM, TOPO_RADIUS = 3986005.000e8, 6378137.0
#: Radii of the line filter (km) and of distances along lines (m).
FILTER_RADIUS_KM, LINE_RADIUS_M = 6378.137, 6378137.0
NMAD_FACTOR = 1.4826
MGAL_PER_SI = 1e5
PROBE_SEED = 144
#: Transverse Mercator zone of the outlier search: latitude and longitude of origin, scale, false easting and northing.
TM_LAT0, TM_LON0, TM_SCALE, TM_EAST, TM_NORTH = 4.0, -73.0, 0.9992, 5_000_000.0, 2_000_000.0
#: GRS80 flattening of the projection.
TM_FLATTENING = 1 / 298.257222101
NODATA = -99999.0
TILE_NODATA = -32768
#: Bounds (of both signs) that maps and reports show.
CLIP_RESIDUAL, CLIP_DISTURBANCE, CLIP_MODEL = 100.0, 60.0, 40.0
