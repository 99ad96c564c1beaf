"""Queries for spatial joins, rasters, projections and scenario tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as X
from ..operators import relational as R
from ..operators import scenario as SC
from ..operators import spatial as SP
from ..operators.aggregates import coverage
from ..operators.ordered import number_rows
from ..operators.sampling import stratified_two_phase
from ..session import scratch_path
from ..sources import scan as SN
from . import roles
from .registry import query, rnd, rounded
from .roles import POINTS_SQL
from .tables import CROP_CODES, CROP_NAMES, PHASES_SQL, seasons

# Code of missing data in the crop raster (fixed value).
NODATA = 65535

STATIONS_SQL = """stations AS (
  SELECT s_suppkey AS station, 6e0 + (s_suppkey % 31) * 29e-2 AS sx, 47e0 + abs(s_acctbal) / 13e2 AS sy FROM supplier)"""


def stations(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("station"), (F.lit(6.0) + (F.col("s_suppkey") % 31) * 0.29).alias("sx"),
        (F.lit(47.0) + F.abs("s_acctbal") / 1300.0).alias("sy"),
    )


_D = "(lon - sx) * (lon - sx) + (lat - sy) * (lat - sy)"


@query("nearest_station", "JN-10 DED-1", f"""
WITH {POINTS_SQL}, {STATIONS_SQL}, d AS (SELECT location, station, {_D} AS d FROM points, stations)
SELECT location, arg_min(station, (d, station)) AS nearest_id, {rnd('sqrt(min(d))')} AS distance FROM d GROUP BY 1""")
def _(t):
    p = roles.points(t).select("location", "lon", "lat")
    return rounded(SP.nearest(p, stations(t), "lon", "lat", "sx", "sy", "station").select("location", "nearest_id", "distance"))


_YEAR_STATIONS_SQL = f"""{STATIONS_SQL}, ys AS (
  SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year, station, sx, sy FROM lineitem JOIN stations ON l_suppkey = station)"""


def year_stations(t):
    seen = t.lineitem.select(
        F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("station")
    ).distinct()
    return seen.join(stations(t), "station")


@query("nearest_station_per_year", "JN-10 PIP-2", f"""
WITH {POINTS_SQL}, {_YEAR_STATIONS_SQL}, d AS (SELECT location, year, station, {_D} AS d FROM points, ys)
SELECT location, year, arg_min(station, (d, station)) AS nearest_id, {rnd('sqrt(min(d))')} AS distance FROM d GROUP BY 1, 2""")
def _(t):
    p = roles.points(t).select("location", "lon", "lat")
    return rounded(SP.nearest(p, year_stations(t), "lon", "lat", "sx", "sy", "station", by=["year"]).select(
        "location", "year", "nearest_id", "distance"
    ))


@query("nearest_grid_cells_with_ties", "JN-11", """
WITH c AS (SELECT p_partkey AS cell, 1e0 * (p_partkey % 40) AS gx, 1e0 * ((p_partkey // 40) % 25) AS gy FROM part),
p AS (SELECT c_custkey AS location, (c_custkey % 79) / 2e0 AS x, (c_custkey % 49) / 2e0 AS y FROM customer),
d AS (SELECT location, cell, (x - gx) * (x - gx) + (y - gy) * (y - gy) AS d FROM p, c),
m AS (SELECT location, min(d) AS m FROM d GROUP BY 1)
SELECT location, cell AS nearest_id FROM d JOIN m USING (location) WHERE d = m""")
def _(t):
    cells = t.part.select(
        F.col("p_partkey").alias("cell"), (F.col("p_partkey") % 40).cast("double").alias("gx"),
        (F.floor(F.col("p_partkey") / 40) % 25).cast("double").alias("gy"),
    )
    p = t.customer.select(
        F.col("c_custkey").alias("location"), ((F.col("c_custkey") % 79) / 2.0).alias("x"), ((F.col("c_custkey") % 49) / 2.0).alias("y")
    )
    return SP.nearest(p, cells, "x", "y", "gx", "gy", "cell", ties="all").select("location", "nearest_id")


@query("points_in_tile_extents", "JN-9 FLT-12", f"""
WITH {POINTS_SQL}, tiles AS (SELECT n_nationkey AS tile, 6e0 + 1.5e0 * (n_nationkey % 5) AS min_x, 7.5e0 + 1.5e0 * (n_nationkey % 5) AS max_x,
  47e0 + 1.5e0 * (n_nationkey // 5) AS min_y, 48.5e0 + 1.5e0 * (n_nationkey // 5) AS max_y FROM nation)
SELECT location, tile FROM points JOIN tiles ON lon BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y""")
def _(t):
    k = F.col("n_nationkey")
    x, y = F.lit(6.0) + F.lit(1.5) * (k % 5), F.lit(47.0) + F.lit(1.5) * F.floor(k / 5)
    tiles = t.nation.select(
        k.alias("tile"), x.alias("min_x"), (F.lit(7.5) + F.lit(1.5) * (k % 5)).alias("max_x"), y.alias("min_y"),
        (F.lit(48.5) + F.lit(1.5) * F.floor(k / 5)).alias("max_y"),
    )
    return SP.in_extent(roles.points(t), tiles, "lon", "lat").select("location", "tile")


_DIAMOND_SQL = """poly AS (SELECT n_nationkey, n_name, 65e-1 + 2e0 * (n_nationkey % 5) AS cx, 475e-1 + 2e0 * (n_nationkey // 5) AS cy FROM nation)"""


def diamonds(t, radius: float, name: str):
    k = F.col("n_nationkey")
    cx, cy = F.lit(6.5) + F.lit(2.0) * (k % 5), F.lit(47.5) + F.lit(2.0) * F.floor(k / 5)

    def corner(dx: float, dy: float):
        return F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))

    ring = F.array(corner(-radius, 0), corner(0, -radius), corner(radius, 0), corner(0, radius))
    return t.nation.select(F.col("n_name").alias(name), ring.alias("ring"))


@query("points_in_polygons", "JN-8 PIP-7", f"""
WITH {POINTS_SQL}, {_DIAMOND_SQL}
SELECT location, n_name AS district FROM points LEFT JOIN poly ON abs(lon - cx) + abs(lat - cy) <= 10123e-4""")
def _(t):
    p = roles.points(t).select("location", "lon", "lat")
    return SP.points_in_polygons(p, diamonds(t, 1.0123, "district"), "lon", "lat").select("location", "district")


@query("points_in_two_polygon_levels", "JN-8 SRC-13", f"""
WITH {POINTS_SQL}, {_DIAMOND_SQL}
SELECT location, a.n_name AS district, b.n_name AS state FROM points
LEFT JOIN poly a ON abs(lon - a.cx) + abs(lat - a.cy) <= 10123e-4 LEFT JOIN poly b ON abs(lon - b.cx) + abs(lat - b.cy) <= 30317e-4
WHERE a.n_name IS NOT NULL""")
def _(t):
    p = roles.points(t).select("location", "lon", "lat")
    one = SP.points_in_polygons(p, diamonds(t, 1.0123, "district"), "lon", "lat")
    two = SP.points_in_polygons(one, diamonds(t, 3.0317, "state"), "lon", "lat")
    return two.dropna(subset=["district"]).select("location", "district", "state")


def _feature(t):
    """GeoJSON features of nations: a diamond with a hole and a part of its own, at level 3, and a plain one at level 1."""
    k = F.col("n_nationkey")
    cx, cy = F.lit(6.5) + F.lit(2.0) * (k % 5), F.lit(47.5) + F.lit(2.0) * F.floor(k / 5)

    def ring(radius: float, dx: float = 0.0):
        corners = [(-radius, 0), (0, -radius), (radius, 0), (0, radius), (-radius, 0)]
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), (cx + dx + a).cast("string"), F.lit(","), (cy + b).cast("string"), F.lit("]")) for a, b in corners]), F.lit("]"))

    def feature(level: int, kind: str, coordinates):
        return F.concat(
            F.lit('{"type":"Feature","properties":{"NAME":"'), F.col("n_name"), F.lit(f'","LEVL_CODE":{level}}},"geometry":{{"type":"{kind}","coordinates":'),
            coordinates, F.lit("}}"))

    parts = F.concat(F.lit("[["), ring(1.0123), F.lit(","), ring(0.4041), F.lit("],["), ring(0.3017, 1.5), F.lit("]]"))
    both = F.array(feature(3, "MultiPolygon", parts), feature(1, "Polygon", F.concat(F.lit("["), ring(3.0317), F.lit("]"))))
    return t.nation.select(F.explode(both).alias("value"))


@query("districts_with_holes_and_parts", "JN-8 SRC-13 PIP-7", f"""
WITH {POINTS_SQL}, {_DIAMOND_SQL}
SELECT location, a.n_name AS district, b.n_name AS state FROM points
JOIN poly a ON (abs(lon - a.cx) + abs(lat - a.cy) <= 10123e-4 AND abs(lon - a.cx) + abs(lat - a.cy) > 4041e-4) OR abs(lon - a.cx - 15e-1) + abs(lat - a.cy) <= 3017e-4
JOIN poly b ON abs(lon - b.cx) + abs(lat - b.cy) <= 30317e-4""")
def _(t):
    path = scratch_path(t.spark, "districts")
    _feature(t).write.text(path)
    shapes = SN.scan_polygons(t.spark, path, ["NAME", "LEVL_CODE"])

    def level(code: str, name: str):
        return shapes.filter(F.col("LEVL_CODE") == code).select(F.col("NAME").alias(name), "rings")

    p = roles.points(t).select("location", "lon", "lat")
    placed = SP.points_in_polygons(p, level("3", "district"), "lon", "lat", "rings")
    return SP.points_in_polygons(placed, level("1", "state"), "lon", "lat", "rings").dropna(subset=["district", "state"]).select("location", "district", "state")


_PIXELS_SQL = """px AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS ix, CAST((p_partkey // 40) % 25 AS INTEGER) AS iy, DATE '2017-01-01' + CAST(p_partkey // 1000 AS INTEGER) AS date, p_size / 1e0 AS value FROM part),
px_at AS (SELECT location, CAST(greatest(0, least(39, floor(lon / 25e-2 - 6e0 / 25e-2 + 5e-1))) AS INTEGER) AS ix,
       CAST(greatest(0, least(24, floor(lat / 32e-2 - 47e0 / 32e-2 + 5e-1))) AS INTEGER) AS iy FROM points)"""


def pixels(t):
    k = F.col("p_partkey")
    return t.part.select(
        (k % 40).cast("int").alias("ix"), (F.floor(k / 40) % 25).cast("int").alias("iy"),
        F.date_add(F.make_date(F.lit(2017), F.lit(1), F.lit(1)), F.floor(k / 1000).cast("int")).alias("date"),
        (F.col("p_size") / 1.0).alias("value"),
    )


@query("nearest_pixel_values", "JN-12", f"WITH {POINTS_SQL}, {_PIXELS_SQL} SELECT location, date, value FROM px_at JOIN px USING (ix, iy)")
def _(t):
    p = roles.points(t).select("location", "lon", "lat")
    return SP.pixel_values(p, pixels(t), "lon", "lat", (6.0, 47.0), (0.25, 0.32), (40, 25)).select("location", "date", "value")


@query("pixel_series_per_point", "PIP-8", f"""
WITH {POINTS_SQL}, {_PIXELS_SQL}, v AS (SELECT location, date, value FROM px_at JOIN px USING (ix, iy))
SELECT location, date, round_even(CASE WHEN (SELECT max(value) FROM v) > 10 THEN value * 1e-1 ELSE value END, 1) AS value FROM v""")
def _(t):
    p = roles.points(t).select("location", "lon", "lat")
    grid = ((6.0, 47.0), (0.25, 0.32), (40, 25))
    # Units are told from the pixels that hold points, and scaled there: the series of all points are made only once.
    used = SP.pixels_with_points(p, pixels(t), "lon", "lat", *grid)
    return SP.pixel_values(p, R.scale_if_raw(used, "value"), "lon", "lat", *grid).select("location", "date", "value")


@query("sinusoidal_coordinates", "FN-G1", f"""
WITH {POINTS_SQL}
SELECT location, {rnd('6371007181e-3 * radians(lon) * cos(radians(lat))', 3)} AS x, {rnd('6371007181e-3 * radians(lat)', 3)} AS y FROM points""")
def _(t):
    p = roles.points(t)
    return rounded(p.select("location", G.sinusoidal_x("lon", "lat").alias("x"), G.sinusoidal_y("lat").alias("y")), 3)


_E2 = "(2e0 / 298.257222101e0 - pow(1e0 / 298.257222101e0, 2))"
_EP2 = f"({_E2} / (1 - {_E2}))"


def utm_sql(src: str, keep: str, lon: str, lat: str) -> str:
    """Subquery: the columns ``keep`` with x, y on the zone-32 grid."""
    return f"""(SELECT {keep},
      5e5 + 9996e-4 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_EP2}) * pow(a, 5) / 120) AS x,
      9996e-4 * (m + n * sqrt(t) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * {_EP2}) * pow(a, 6) / 720)) AS y
    FROM (SELECT *, 6378137e0 / sqrt(1 - {_E2} * pow(sin(radians({lat})), 2)) AS n, pow(tan(radians({lat})), 2) AS t,
      {_EP2} * pow(cos(radians({lat})), 2) AS c, radians({lon} - 9) * cos(radians({lat})) AS a,
      6378137e0 * ((1 - {_E2} / 4 - 3 * pow({_E2}, 2) / 64 - 5 * pow({_E2}, 3) / 256) * radians({lat})
        - (3 * {_E2} / 8 + 3 * pow({_E2}, 2) / 32 + 45 * pow({_E2}, 3) / 1024) * sin(2 * radians({lat}))
        + (15 * pow({_E2}, 2) / 256 + 45 * pow({_E2}, 3) / 1024) * sin(4 * radians({lat})) - 35 * pow({_E2}, 3) / 3072 * sin(6 * radians({lat}))) AS m
      FROM {src}))"""


def metric(df, lon: str, lat: str, x: str = "x", y: str = "y"):
    u = G.utm_xy(lon, lat)
    return df.withColumn("_u", u).select(*df.columns, F.col("_u.x").alias(x), F.col("_u.y").alias(y))


@query("nearest_station_on_metric_grid", "PIP-2 JN-10 FN-G2", f"""
WITH {POINTS_SQL}, {_YEAR_STATIONS_SQL}, p AS (SELECT * FROM {utm_sql('points', 'location', 'lon', 'lat')}),
s AS (SELECT * FROM {utm_sql('ys', 'year, station', 'sx', 'sy')}),
d AS (SELECT location, year, station, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS d FROM p, s)
SELECT location, year, arg_min(station, (d, station)) AS nearest_id, {rnd('sqrt(min(d))', 2)} AS distance FROM d GROUP BY 1, 2""")
def _(t):
    p = metric(roles.points(t).select("location", "lon", "lat"), "lon", "lat")
    s = metric(year_stations(t), "sx", "sy", "mx", "my")
    return rounded(SP.nearest(p, s, "x", "y", "mx", "my", "station", by=["year"]).select("location", "year", "nearest_id", "distance"), 2)


_SAMPLE_SQL = f"""r AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 1110 WHEN p_size % 6 = 1 THEN 1130 WHEN p_size % 6 = 2 THEN 1310 WHEN p_size % 6 = 3 THEN 2200 WHEN p_size % 6 = 4 THEN 1430 ELSE 65535 END AS crop_id,
  p_partkey // 500 AS block, 6e0 + 9e-2 * (p_partkey % 97) AS x, 47e0 + 95e-3 * ((p_partkey // 97) % 83) AS y FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY block, crop_id ORDER BY p_partkey) AS k FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY p_partkey) AS k2 FROM a WHERE k <= 30)"""


@query("class_sample_with_states", "PIP-7 SMP-1 JN-8 PRJ-4", f"""
WITH {_SAMPLE_SQL}, {_DIAMOND_SQL},
j AS (SELECT p_partkey, crop_id, n_name AS "STATE_NAME" FROM b JOIN poly ON abs(x - cx) + abs(y - cy) <= 10123e-4 WHERE k2 <= 120 AND crop_id <> 65535)
SELECT row_number() OVER (ORDER BY crop_id, p_partkey, "STATE_NAME") - 1 AS point_id, p_partkey, crop_id,
       CASE crop_id WHEN 1110 THEN 'Wheat' WHEN 1130 THEN 'Maize' WHEN 1310 THEN 'Potatoes' ELSE 'Rapeseed' END AS crop_type, "STATE_NAME"
FROM j WHERE crop_id <> 2200""")
def _(t):
    k, z = F.col("p_partkey"), F.col("p_size") % 6
    code = F.when(z == 0, 1110).when(z == 1, 1130).when(z == 2, 1310).when(z == 3, 2200).when(z == 4, 1430).otherwise(65535)
    raster = t.part.select(
        "p_partkey", code.alias("crop_id"), F.floor(k / 500).alias("block"), (F.lit(6.0) + F.lit(0.09) * (k % 97)).alias("x"),
        (F.lit(47.0) + F.lit(0.095) * (F.floor(k / 97) % 83)).alias("y"),
    )
    drawn = stratified_two_phase(raster, "block", "crop_id", ["p_partkey"], 30, 120, order=[k])
    named = drawn.filter(F.col("crop_id") != NODATA).withColumn(
        "crop_type", R.recode(F.col("crop_id").cast("string"), {str(c): n for c, n in CROP_CODES.items()})
    )
    placed = SP.points_in_polygons(named, diamonds(t, 1.0123, "STATE_NAME"), "x", "y", how="inner")
    wanted = placed.filter(F.col("crop_type").isin(*CROP_NAMES)).select("p_partkey", "crop_id", "crop_type", "STATE_NAME")
    return number_rows(wanted, ["crop_id", "p_partkey", "STATE_NAME"], "point_id", start=0)


@query("metric_grid_coordinates", "FN-G2", f"""
WITH {POINTS_SQL} SELECT location, {rnd('x', 3)} AS x, {rnd('y', 3)} AS y FROM {utm_sql('points', 'location', 'lon', 'lat')}""")
def _(t):
    p = roles.points(t)
    return rounded(p.select("location", G.utm_xy("lon", "lat").alias("u")).select("location", "u.x", "u.y"), 3)


@query("raster_pixel_centres", "FN-G3", f"""
SELECT p_partkey, {rnd('3e1 * ((p_partkey % 50) + 5e-1) + 4e6', 3)} AS x, {rnd('-3e1 * ((p_partkey // 50) + 5e-1) + 35e5', 3)} AS y FROM part""")
def _(t):
    return rounded(t.part.select(
        "p_partkey", G.pixel_centre(F.col("p_partkey") % 50, 30.0, 4e6).alias("x"),
        G.pixel_centre(F.floor(F.col("p_partkey") / 50), -30.0, 35e5).alias("y"),
    ), 3)


@query("raster_stack_from_names", "SRC-15 FN-D3 FN-S7", """
SELECT p_partkey, concat('h', lpad(CAST(p_partkey % 36 AS VARCHAR), 2, '0'), 'v', lpad(CAST(p_partkey % 18 AS VARCHAR), 2, '0')) AS tile,
       make_date(2017 + CAST(p_partkey % 5 AS INTEGER), 1, 1) + CAST(p_partkey % 365 AS INTEGER) AS date, p_size AS value FROM part""")
def _(t):
    k = F.col("p_partkey")
    name = F.concat(
        F.lit("/stack/2017/LAI.A"), (F.lit(2017) + k % 5).cast("string"), F.lpad((k % 365 + 1).cast("string"), 3, "0"),
        F.lit(".h"), F.lpad((k % 36).cast("string"), 2, "0"), F.lit("v"), F.lpad((k % 18).cast("string"), 2, "0"), F.lit(".hdf"),
    )
    base = X.base_name(name)
    return t.part.select(
        "p_partkey", X.tile_id(base).alias("tile"), X.acquisition_date(base).alias("date"), F.col("p_size").alias("value")
    )


@query("raster_classes_without_nodata", "SRC-14", """
SELECT CAST(p_partkey // 50 AS BIGINT) AS row_no, p_partkey % 50 AS col_no, p_size AS crop_id FROM part WHERE p_size NOT IN (0, 50)""")
def _(t):
    return t.part.filter(~F.col("p_size").isin(0, 50)).select(
        F.floor(F.col("p_partkey") / 50).alias("row_no"), (F.col("p_partkey") % 50).alias("col_no"), F.col("p_size").alias("crop_id")
    )


# ------------------------------------------------------------------- scenarios

_REG_SQL = """reg AS (SELECT * FROM (VALUES ('DWD', 'baseline', 0, 0), ('HYRAS_OBS', 'historical', 1951, 2014)) v(climate, kind, s, e)
 UNION ALL SELECT concat(m, '_historical'), 'historical', 1951, 2014 FROM unnest(['ACCESS-CM2', 'CanESM5', 'EC-Earth3', 'GFDL-ESM4', 'MIROC6']) t(m)
 UNION ALL SELECT concat(m, '_', p), 'future', 2015, 2100 FROM unnest(['ACCESS-CM2', 'CanESM5', 'EC-Earth3', 'GFDL-ESM4', 'MIROC6']) t(m), unnest(['ssp126', 'ssp370']) u(p))"""


@query("scenario_matrix_per_district", "SET-10 JN-7", f"""
WITH {_REG_SQL}, {POINTS_SQL}, d AS (SELECT NUTS_ID, count(*) AS n_points FROM points GROUP BY 1)
SELECT NUTS_ID, n_points, crop, climate, kind, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", soil, concat(climate, '__', soil) AS exp_id
FROM d, reg, unnest(['winter_wheat', 'winter_rapeseed', 'spring_barley', 'potato', 'maize']) c(crop), unnest(['S1', 'S2', 'S3', 'DL', 'DLB']) z(soil)""")
def _(t):
    matrix = SC.scenario_matrix(t.spark, SC.CROPS, SC.climate_registry(t.spark), SC.SOILS)
    d = roles.points(t).groupBy("NUTS_ID").agg(F.count(F.lit(1)).alias("n_points"))
    # The matrix is the fixed 425-row design.
    return d.crossJoin(F.broadcast(matrix))


@query("expand_start_years", "SET-9", """
SELECT c_custkey, CAST(y AS INTEGER) AS year FROM customer, range(1995, 2001) r(y)""")
def _(t):
    return SC.expand_years(t.customer.select("c_custkey"), 1995, 2001, 1)


BASELINE_SQL = """base AS (SELECT o_custkey AS vLocationID, concat('N', CAST(c_nationkey AS VARCHAR)) AS vNUTS_ID, CAST(dayofyear(o_orderdate) AS INTEGER) AS vIDPL
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 7)"""


def baseline(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter(
        (F.col("c_mktsegment") != "BUILDING") & (F.col("c_nationkey") != 7)
    ).select(
        F.col("o_custkey").alias("vLocationID"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("vNUTS_ID"),
        F.dayofyear("o_orderdate").alias("vIDPL"),
    )


@query("scenario_task_table", "PIP-5 FN-S1 FN-D5", f"""
WITH {POINTS_SQL}, {BASELINE_SQL},
m AS (SELECT vNUTS_ID AS NUTS_ID, CAST(round_even(quantile_cont(vIDPL, 0.5), 0) AS INTEGER) AS d FROM base GROUP BY 1),
g AS (SELECT CAST(round_even(quantile_cont(vIDPL, 0.5), 0) AS INTEGER) AS d FROM base),
cov AS (SELECT min(CAST(o_orderdate AS DATE)) AS f, make_date(2001, 12, 31) AS l FROM orders),
r AS (SELECT cell AS simulationid, CAST(regexp_extract(cell, '^C(\\d+)R(\\d+)$', 1) AS INTEGER) AS vColumn, CAST(regexp_extract(cell, '^C(\\d+)R(\\d+)$', 2) AS INTEGER) AS vRow,
             location AS vLocationID, NUTS_ID AS vNUTS_ID, NUTS_NAME, STATE_NAME, coalesce(m.d, g.d) AS vIDPL,
             make_date(y, 1, 1) AS start_date, make_date(y + 1, 12, 31) AS end_date
      FROM points LEFT JOIN m USING (NUTS_ID) CROSS JOIN g CROSS JOIN range(1994, 2002) t(y) WHERE location IN (SELECT vLocationID FROM base))
SELECT row_number() OVER (ORDER BY vLocationID, start_date) AS projectid, r.* FROM r, cov WHERE start_date >= f AND end_date <= l""")
def _(t):
    cov = coverage(t.orders.withColumn("d", F.col("o_orderdate").cast("date")), [], "d").withColumn(
        "last", F.make_date(F.lit(2001), F.lit(12), F.lit(31))
    )
    return SC.task_table(
        roles.points(t), baseline(t), 1994, 2002, 1, cov, point="location", cell="cell", admin=["NUTS_NAME", "STATE_NAME"]
    )


@query("sowing_task_table", "PIP-4 FN-S2 FN-D1", f"""
WITH {POINTS_SQL}, s AS (SELECT o_custkey AS location, CAST(o_orderdate AS DATE) AS sowing_date, o_orderkey FROM orders),
f AS (SELECT location, sowing_date FROM (SELECT *, row_number() OVER (PARTITION BY location, year(sowing_date) ORDER BY sowing_date, o_orderkey) AS k FROM s) WHERE k = 1)
SELECT row_number() OVER (ORDER BY location, sowing_date) AS projectid, concat('C', CAST(location % 97 AS VARCHAR), 'R', CAST((location * 7) % 83 AS VARCHAR)) AS simulationid,
       CAST(location % 97 AS INTEGER) AS vColumn, CAST((location * 7) % 83 AS INTEGER) AS vRow, location AS vLocationID, NUTS_ID, CAST(dayofyear(sowing_date) AS INTEGER) AS vIDPL,
       make_date(year(sowing_date), 1, 1) AS start_date, make_date(year(sowing_date) + 1, 12, 31) AS end_date, CAST(year(sowing_date) + 1 AS INTEGER) AS vYear
FROM points JOIN f USING (location)""")
def _(t):
    p = roles.points(t).select("location", "NUTS_ID", X.grid_column("cell").alias("vColumn"), X.grid_row("cell").alias("vRow"))
    s = t.orders.select(
        F.col("o_custkey").alias("location"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").cast("date").alias("sowing_date"),
        "o_orderkey", F.dayofyear("o_orderdate").alias("sowing_doy"),
    )
    first = R.first_per_key(s, ["location", "y"], ["sowing_date", "o_orderkey"])
    return SC.sowing_tasks(p, first, F.lit("winter_wheat"), point="location")


@query("season_table_from_phases", "PIP-1", f"""
WITH {PHASES_SQL} SELECT * FROM chain WHERE sowing_date < emergence_date AND emergence_date < flowering_date AND flowering_date < maturity_date""")
def _(t):
    return R.valid_sequence(seasons(t), ["sowing_date", "emergence_date", "flowering_date", "maturity_date"])


@query("median_calendar_for_future_years", "PIP-3 FN-D4", """
WITH o AS (SELECT o_custkey AS station, CAST(year(o_orderdate) AS INTEGER) AS hy, CAST(dayofyear(o_orderdate) AS INTEGER) AS a, CAST(dayofyear(o_orderdate) AS INTEGER) + 40 AS b FROM orders),
m AS (SELECT station, CAST(round_even(quantile_cont(a, 0.5), 0) AS INTEGER) AS a, CAST(round_even(quantile_cont(b, 0.5), 0) AS INTEGER) AS b FROM o GROUP BY 1)
SELECT station, CAST(y AS INTEGER) AS harvest_year, a AS sowing_doy, b AS emergence_doy, make_date(y, 1, 1) + (a - 1) AS sowing_date,
       make_date(y, 1, 1) + (b - 1) AS emergence_date, true AS valid_sequence FROM m, range((SELECT max(hy) + 1 FROM o), 2006) r(y)""")
def _(t):
    d = F.dayofyear("o_orderdate")
    o = t.orders.select(
        F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("harvest_year"), d.alias("sowing_doy"), (d + 40).alias("emergence_doy")
    )
    return SC.extend_calendar(o, ["station"], ["sowing", "emergence"], 2005)


@query("fertiliser_and_location_tables", "PIP-6 PRJ-2", f"""
WITH {POINTS_SQL}, ev(Event, vType, DVS, Amount) AS (VALUES (1, 'Urea', 1e-3, 85e-1), (1, 'P', 1e-3, 2062e-2), (1, 'K', 1e-3, 2649e-2), (2, 'Urea', 3e-1, 127e-1), (3, 'Urea', 5e-1, 179e-1)),
tasks AS (SELECT DISTINCT o_custkey AS vLocationID FROM orders WHERE o_totalprice > 2e5)
SELECT location, 2 AS FertilizerScenario, 'potato' AS crop, CAST(Event AS INTEGER) AS Event, vType, DVS, Amount, {rnd('lat', 4)} AS Latitude, -4 AS SunInclination, 10 AS Altitude
FROM tasks JOIN points ON vLocationID = location, ev""")
def _(t):
    tasks = t.orders.filter(F.col("o_totalprice") > 2e5).select(F.col("o_custkey").alias("vLocationID"))
    fert = SC.fertiliser_table(tasks, "potato")
    loc = SC.location_table(roles.points(t), tasks, point="location", latitude="lat")
    return rounded(fert.join(loc, "location"), 4)


@query("cells_with_a_weather_file", "JN-6", f"""
WITH {POINTS_SQL} SELECT location, cell FROM points WHERE location % 97 IN (SELECT s_suppkey % 97 FROM supplier WHERE s_acctbal > 4e3)
  AND (location * 7) % 83 IN (SELECT (s_suppkey * 3) % 83 FROM supplier)""")
def _(t):
    # A catalog of file names built from the tables: one per (column, row).
    cols = t.supplier.filter(F.col("s_acctbal") > 4e3).select((F.col("s_suppkey") % 97).alias("c")).distinct()
    rows = t.supplier.select(((F.col("s_suppkey") * 3) % 83).alias("r")).distinct()
    files = cols.crossJoin(F.broadcast(rows)).select(
        F.concat(F.lit("/climate/"), F.col("r").cast("string"), F.lit("/daily_mean_RES1_C"), F.col("c").cast("string"),
                 F.lit("R"), F.col("r").cast("string"), F.lit(".csv.gz")).alias("path")
    )
    parsed = files.select(F.regexp_extract("path", r"_(C\d+R\d+)\.csv\.gz$", 1).alias("cell"))
    return R.keep_members(roles.points(t).select("location", "cell"), parsed, ["cell"])


@query("districts_numbered_by_size", "PRJ-13 SRT-1", f"""
WITH {POINTS_SQL}, d AS (SELECT NUTS_ID, count(*) AS n FROM points GROUP BY 1)
SELECT NUTS_ID, n, row_number() OVER (ORDER BY n DESC, NUTS_ID) AS position FROM d""")
def _(t):
    d = roles.points(t).groupBy("NUTS_ID").agg(F.count(F.lit(1)).alias("n"))
    return number_rows(d, [F.col("n").desc(), F.col("NUTS_ID")], "position")
