"""The given tables in the roles of the analysis: one Spark builder and one SQL text per role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import district_year
from ..operators.relational import pair
from ..session import stage

# ------------------------------------------------------------ points and admin

POINTS_SQL = """points AS (
  SELECT c_custkey AS location, concat('N', CAST(c_nationkey AS VARCHAR)) AS NUTS_ID, n_name AS NUTS_NAME,
         r_name AS STATE_NAME, 6e0 + (c_custkey % 97) * 9e-2 AS lon, 47e0 + ((c_custkey * 7) % 83) * 9.5e-2 AS lat,
         concat('C', CAST(c_custkey % 97 AS VARCHAR), 'R', CAST((c_custkey * 7) % 83 AS VARCHAR)) AS cell
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def points(t) -> DataFrame:
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("location"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("NUTS_ID"),
            F.col("n_name").alias("NUTS_NAME"),
            F.col("r_name").alias("STATE_NAME"),
            (F.lit(6.0) + (F.col("c_custkey") % 97) * 0.09).alias("lon"),
            (F.lit(47.0) + ((F.col("c_custkey") * 7) % 83) * 0.095).alias("lat"),
            F.concat(
                F.lit("C"), (F.col("c_custkey") % 97).cast("string"),
                F.lit("R"), ((F.col("c_custkey") * 7) % 83).cast("string"),
            ).alias("cell"),
        )
    )


# ------------------------------------------------------------- yearly results

SIM_SQL = """sim AS (
  SELECT o_orderkey AS row_id, o_custkey AS location, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_totalprice / 5e4 AS yield_sim,
         o_totalprice / 5e4 / (3e-1 + 5e-2 * (o_orderkey % 5)) AS biomass,
         o_totalprice / 5e4 * (9.7e-1 + 2e-2 * (o_orderkey % 4)) AS translocated,
         1e0 - 1e-2 * (o_orderkey % 50) AS tranrf
  FROM orders)"""


def sim_yearly(t) -> DataFrame:
    y = F.col("o_totalprice") / 50000.0
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("location"),
        F.year("o_orderdate").alias("year"),
        y.alias("yield_sim"),
        (y / (F.lit(0.3) + F.lit(0.05) * (F.col("o_orderkey") % 5))).alias("biomass"),
        (y * (F.lit(0.97) + F.lit(0.02) * (F.col("o_orderkey") % 4))).alias("translocated"),
        (F.lit(1.0) - F.lit(0.01) * (F.col("o_orderkey") % 50)).alias("tranrf"),
    )


OBS_YIELD_SQL = """obs_yield AS (
  SELECT concat('N', CAST(s_nationkey AS VARCHAR)) AS NUTS_ID, CAST(year(l_shipdate) AS INTEGER) AS year,
         avg(l_extendedprice) / 1e4 AS yield
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def obs_yield(t) -> DataFrame:
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("NUTS_ID"),
            F.year("l_shipdate").alias("year"),
        )
        .agg((F.avg("l_extendedprice") / 10000.0).alias("yield"))
    )


PAIRS_SQL = f"""{POINTS_SQL}, {SIM_SQL}, {OBS_YIELD_SQL},
sim_district AS (
  SELECT NUTS_ID, STATE_NAME, year, avg(yield_sim) AS yield_sim, avg(biomass) AS biomass,
         avg(translocated) AS translocated, avg(tranrf) AS tranrf, count(DISTINCT location) AS n_points
  FROM sim JOIN points USING (location) GROUP BY 1, 2, 3),
pairs AS (
  SELECT s.*, o.yield FROM sim_district s JOIN obs_yield o USING (NUTS_ID, year) WHERE o.yield > 0)"""


def yield_pairs(t) -> DataFrame:
    """District-year pairs: points averaged to districts, joined to observed districts."""
    admin = points(t).select("location", "NUTS_ID", "STATE_NAME")
    sim = sim_yearly(t).join(admin, "location")
    district = district_year(
        sim, ["NUTS_ID", "STATE_NAME", "year"], ["yield_sim", "biomass", "translocated", "tranrf"], "location"
    )
    return pair(district, obs_yield(t), ["NUTS_ID", "year"]).filter(F.col("yield") > 0)


def staged_yield_pairs(t) -> DataFrame:
    """The pairs written once (one row per district and year) for analyses that read them several times."""
    return stage(yield_pairs(t), "pairs")


# ----------------------------------------------------------------- phenology

SIM_PHEN_SQL = """sim_phen AS (
  SELECT l_orderkey AS PointID, CAST(year(max(l_shipdate)) AS INTEGER) AS harvest_year,
         strftime(min(l_shipdate), '%d.%m.%Y') AS anthesis_date,
         CAST(year(min(l_shipdate)) AS INTEGER) AS anthesis_year,
         CAST(dayofyear(min(l_shipdate)) AS INTEGER) AS flowering_doy_sim,
         CAST(dayofyear(max(l_shipdate)) AS INTEGER) AS maturity_doy_sim
  FROM lineitem GROUP BY 1)"""


def sim_phenology(t) -> DataFrame:
    return (
        t.lineitem.groupBy(F.col("l_orderkey").alias("PointID"))
        .agg(F.min("l_shipdate").alias("_a"), F.max("l_shipdate").alias("_m"))
        .select(
            "PointID",
            F.year("_m").alias("harvest_year"),
            F.date_format("_a", "dd.MM.yyyy").alias("anthesis_date"),
            F.dayofyear("_a").alias("flowering_doy_sim"),
            F.dayofyear("_m").alias("maturity_doy_sim"),
        )
    )


OBS_PHEN_SQL = """obs_phen AS (
  SELECT o_orderkey AS PointID, CAST(year(o_orderdate + INTERVAL 75 DAY) AS INTEGER) AS harvest_year,
         r_name AS STATE_NAME, n_name AS NUTS_NAME, c_custkey AS site,
         CAST(dayofyear(o_orderdate + INTERVAL 20 DAY) AS INTEGER) AS flowering_doy,
         CAST(dayofyear(o_orderdate + INTERVAL 75 DAY) AS INTEGER) AS maturity_doy,
         o_orderstatus <> 'P' AS valid_sequence, 47e0 + ((c_custkey * 7) % 83) * 9.5e-2 AS lat
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def obs_phenology(t) -> DataFrame:
    d20, d75 = F.date_add("o_orderdate", 20), F.date_add("o_orderdate", 75)
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("PointID"),
            F.year(d75).alias("harvest_year"),
            F.col("r_name").alias("STATE_NAME"),
            F.col("n_name").alias("NUTS_NAME"),
            F.col("c_custkey").alias("site"),
            F.dayofyear(d20).alias("flowering_doy"),
            F.dayofyear(d75).alias("maturity_doy"),
            (F.col("o_orderstatus") != "P").alias("valid_sequence"),
            (F.lit(47.0) + ((F.col("c_custkey") * 7) % 83) * 0.095).alias("lat"),
        )
    )


PHEN_SQL = f"""{SIM_PHEN_SQL}, {OBS_PHEN_SQL},
phen_all AS (
  SELECT s.*, o.STATE_NAME, o.NUTS_NAME, o.site, o.flowering_doy, o.maturity_doy, o.valid_sequence, o.lat,
         s.anthesis_year < s.harvest_year AS abnormal
  FROM sim_phen s JOIN obs_phen o USING (PointID, harvest_year)),
phen AS (
  SELECT *, maturity_doy - flowering_doy AS duration_obs, maturity_doy_sim - flowering_doy_sim AS duration_sim
  FROM phen_all WHERE NOT abnormal)"""

# ------------------------------------------------------------------- canopy

# Stage bins from emergence to maturity (fixed values).
STAGE_EDGES = [0.0, 0.25, 0.5, 1.0, 1.25, 1.5, 1.75, 2.0]

DAILY_SQL = """daily AS (
  SELECT user_id AS location, CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year,
         round((dayofyear(ts) - 1) * 7.5e-2, 4) AS dvs, avg(value) / 2e1 AS LAI_sim
  FROM events WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY 1, 2, 3, 4),
obs_lai AS (
  SELECT user_id AS location, CAST(ts AS DATE) AS date, avg(value) / 2e1 AS LAI
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)"""


def daily_canopy(t) -> DataFrame:
    day = F.col("ts").cast("date")
    return (
        t.events.filter(F.col("event_type").isin("error", "signup", "purchase"))
        .groupBy(
            F.col("user_id").alias("location"), day.alias("date"), F.year("ts").alias("year"),
            F.round((F.dayofyear("ts") - 1) * 0.075, 4).alias("dvs"),
        )
        .agg((F.avg("value") / 20.0).alias("LAI_sim"))
    )


def obs_canopy(t) -> DataFrame:
    return (
        t.events.filter(F.col("event_type").isin("click", "view"))
        .groupBy(F.col("user_id").alias("location"), F.col("ts").cast("date").alias("date"))
        .agg((F.avg("value") / 20.0).alias("LAI"))
    )


CANOPY_SQL = f"""{DAILY_SQL},
cut AS (SELECT location, min(date) FILTER (WHERE dvs >= 2) AS first_mature FROM daily WHERE dvs > 0 GROUP BY 1),
canopy AS (
  SELECT d.location, d.date, d.year, d.dvs, d.LAI_sim, o.LAI
  FROM daily d JOIN cut USING (location) JOIN obs_lai o USING (location, date)
  WHERE d.dvs > 0 AND (first_mature IS NULL OR d.date <= first_mature))"""

# Winter seasons (October to September) over suppliers, with new-year wraps.
SEASON_SQL = """season AS (
  SELECT l_suppkey AS location, CAST(year(l_shipdate + INTERVAL 92 DAY) AS INTEGER) AS year,
         CAST(l_shipdate AS DATE) AS date,
         round(date_diff('day', make_date(year(l_shipdate + INTERVAL 92 DAY) - 1, 10, 1), CAST(l_shipdate AS DATE)) / 1.8e2, 4) AS dvs,
         avg(l_quantity) / 8e0 AS LAI, avg(l_extendedprice) / 1.6e4 AS LAI_sim
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def season_pairs(t) -> DataFrame:
    y = F.year(F.date_add("l_shipdate", 92))
    day = F.col("l_shipdate").cast("date")
    start = F.make_date(y - 1, F.lit(10), F.lit(1))
    return (
        t.lineitem.groupBy(
            F.col("l_suppkey").alias("location"), y.alias("year"), day.alias("date"),
            F.round(F.datediff(day, start) / 180.0, 4).alias("dvs"),
        )
        .agg((F.avg("l_quantity") / 8.0).alias("LAI"), (F.avg("l_extendedprice") / 16000.0).alias("LAI_sim"))
    )


# ------------------------------------------------------------ monthly series

MONTHLY_SQL = """monthly AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         round(avg(o_totalprice) / 1e3, 4) AS average
  FROM orders GROUP BY 1, 2)"""


def monthly(t) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.round(F.avg("o_totalprice") / 1000.0, 4).alias("average")
    )


ANNUAL_SQL = """annual AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_extendedprice) / 2e2, 4) AS level
  FROM lineitem GROUP BY 1)"""


def annual(t) -> DataFrame:
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.round(F.avg("l_extendedprice") / 200.0, 4).alias("level")
    )


# -------------------------------------------------------------------- ledger

LEDGER_SQL = """ledger AS (
  SELECT event_id AS iteration, user_id AS crop,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS objective, props
  FROM events)"""


def ledger(t) -> DataFrame:
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.col("event_id").alias("iteration"), F.col("user_id").alias("crop"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~failed, F.col("value")).alias("objective"), "props",
    )


# ------------------------------------------------------------- short tables

TABLES_SQL = """elements AS (
  SELECT l_orderkey AS set_id, l_linenumber AS idx, avg(l_quantity) AS value, max(l_discount) AS x
  FROM lineitem GROUP BY 1, 2)"""


def elements(t) -> DataFrame:
    """Per order a short table of elements: (set_id, idx, value, x)."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("idx")).agg(
        F.avg("l_quantity").alias("value"), F.max("l_discount").alias("x")
    )


