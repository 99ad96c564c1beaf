"""Queries for projections, filters, joins, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import text as X
from ..operators import relational as R
from ..operators import sampling as S
from ..operators.aggregates import coverage
from ..operators.ordered import number_rows
from ..plans import views as V
from ..session import stage
from . import roles
from .registry import query, rnd, rounded
from .roles import DAILY_SQL, OBS_PHEN_SQL, PAIRS_SQL, PHEN_SQL, POINTS_SQL, SIM_PHEN_SQL, SIM_SQL

# Class codes of the crop raster (fixed values).
CROP_CODES = {
    1110: "Wheat", 1120: "Barley", 1130: "Maize", 1140: "Rice", 1150: "Other cereals",
    1210: "Fresh Vegetables", 1220: "Dry pulses", 1310: "Potatoes", 1320: "Sugar Beet", 1410: "Sunflower",
    1420: "Soybeans", 1430: "Rapeseed", 1440: "Flax, cotton and hemp", 2100: "Grapes", 2200: "Olives",
    2310: "Fruits", 2320: "Nuts", 3100: "Unclassified arable crop", 3200: "Unclassified permanent crop",
}
CROP_NAMES = {
    "Wheat": "winter_wheat", "Barley": "spring_barley", "Maize": "maize", "Potatoes": "potato",
    "Sugar Beet": "sugar_beet", "Rapeseed": "winter_rapeseed",
}
_CODES = list(CROP_CODES)
_CODE_SQL = "CASE c " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CROP_CODES.items()) + " ELSE CAST(c AS VARCHAR) END"
_NAME_SQL = "CASE n " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CROP_NAMES.items()) + " ELSE n END"
_PICK_SQL = "[" + ", ".join(str(c) for c in _CODES) + ", 65535, 9999]"

# ---------------------------------------------------------------- projections


@query("select_rename_reorder", "PRJ-1 SRC-3", """
SELECT o_custkey AS location, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS yield_sim FROM orders""")
def _(t):
    return (
        t.orders.withColumnsRenamed({"o_custkey": "location", "o_totalprice": "yield_sim"})
        .select("location", F.year("o_orderdate").alias("year"), "yield_sim")
    )


@query("constant_columns", "PRJ-2", """
SELECT c_custkey AS location, 2 AS FertilizerScenario, -4 AS SunInclination, 10 AS Altitude FROM customer""")
def _(t):
    return t.customer.select(
        F.col("c_custkey").alias("location"), F.lit(2).alias("FertilizerScenario"),
        F.lit(-4).alias("SunInclination"), F.lit(10).alias("Altitude"),
    )


@query("swap_id_columns", "PRJ-3", """
SELECT o_custkey AS projectid, o_orderkey AS simulationid, o_orderpriority FROM orders""")
def _(t):
    df = t.orders.select(
        F.col("o_orderkey").alias("projectid"), F.col("o_custkey").alias("simulationid"), "o_orderpriority"
    )
    return R.swap_columns(df, "projectid", "simulationid")


@query("recode_classes", "PRJ-4", f"""
WITH p AS (SELECT p_partkey, {_PICK_SQL}[1 + p_partkey % 21] AS c FROM part),
q AS (SELECT p_partkey, {_CODE_SQL} AS n FROM p)
SELECT p_partkey, n AS crop_type, {_NAME_SQL} AS crop FROM q""")
def _(t):
    picks = F.array(*[F.lit(c) for c in [*_CODES, 65535, 9999]])
    code = F.element_at(picks, (F.col("p_partkey") % 21).cast("int") + 1)
    named = {str(k): v for k, v in CROP_CODES.items()}
    df = t.part.select("p_partkey", R.recode(code.cast("string"), named).alias("crop_type"))
    return df.withColumn("crop", R.recode("crop_type", CROP_NAMES))


@query("lookup_with_default", "PRJ-5", """
SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 7 ELSE 3 END AS INTEGER) AS day
FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", R.lookup_or("c_mktsegment", {"BUILDING": 5, "MACHINERY": 7}, 3).alias("day")
    )


# Dry-matter factor per crop (fixed values).
DRY_MATTER = {"winter_wheat": 1.0, "winter_rapeseed": 1.0, "spring_barley": 1.0, "potato": 0.21, "maize": 1.0}


@query("unit_scaling", "PRJ-6", f"""
SELECT l_orderkey, l_linenumber, {rnd("l_extendedprice * CASE l_returnflag WHEN 'A' THEN 2.1e-1 WHEN 'R' THEN 1e0 ELSE 1e0 END", 4)} AS adjusted
FROM lineitem""")
def _(t):
    crop = R.recode("l_returnflag", {"A": "potato", "R": "maize"})
    factor = R.lookup_or(crop, DRY_MATTER, 1.0)
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * factor).alias("adjusted")), 4)


_ES = "(61.08e-2 * exp(17.27e0 * {t} / ({t} + 237.3e0)))"


@query("weather_derivation", "PRJ-7 FN-M1", f"""
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity / 2e0 AS tmin, l_quantity / 2e0 + 1e2 * l_discount AS tmax,
                  l_extendedprice AS irr FROM lineitem)
SELECT l_orderkey, l_linenumber, {rnd('irr / 1e3', 6)} AS radiation_mj,
       {rnd('(' + _ES.format(t='tmax') + ' + ' + _ES.format(t='tmin') + ') * 5e-1')} AS e_s,
       {rnd(_ES.format(t='tmin'))} AS e_a, {rnd('(tmin + tmax) * 5e-1')} AS tmean
FROM w""")
def _(t):
    w = t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 2.0).alias("tmin"),
        (F.col("l_quantity") / 2.0 + 100.0 * F.col("l_discount")).alias("tmax"),
        F.col("l_extendedprice").alias("irr"),
    )
    lo, hi = N.saturation_vapour_pressure("tmin"), N.saturation_vapour_pressure("tmax")
    return rounded(w.select(
        "l_orderkey", "l_linenumber", (F.col("irr") / 1000.0).alias("radiation_mj"),
        ((hi + lo) * 0.5).alias("e_s"), lo.alias("e_a"), ((F.col("tmin") + F.col("tmax")) * 0.5).alias("tmean"),
    ))


@query("sentinel_fallback", "PRJ-8", """
SELECT c_custkey, CASE WHEN c_acctbal < -99 THEN c_custkey / 1e1 ELSE c_acctbal END AS radiation FROM customer""")
def _(t):
    return t.customer.select(
        "c_custkey", R.sentinel_fallback("c_acctbal", F.col("c_custkey") / 10.0).alias("radiation")
    )


@query("scale_if_raw", "PRJ-9", """
SELECT l_orderkey, l_linenumber, l_suppkey,
       round_even(CASE WHEN (SELECT max(l_quantity) FROM lineitem) > 10 THEN l_quantity * 1e-1 ELSE l_quantity END, 1) AS lai
FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("lai"))
    return R.scale_if_raw(df, "lai")


@query("band_scaling", "PRJ-10", f"""
SELECT p_partkey, {rnd('p_retailprice / 1e2')} AS bdod, {rnd('p_retailprice / 1e1')} AS cec, {rnd('p_size / 1e1')} AS clay
FROM part""")
def _(t):
    return rounded(t.part.select(
        "p_partkey", (F.col("p_retailprice") / 100.0).alias("bdod"), (F.col("p_retailprice") / 10.0).alias("cec"),
        (F.col("p_size") / 10.0).alias("clay"),
    ))


@query("residual_and_duration", "PRJ-11", f"""
WITH {PHEN_SQL}
SELECT PointID, duration_obs, duration_sim, flowering_doy_sim - flowering_doy AS flowering_residual,
       duration_sim - duration_obs AS duration_residual FROM phen""")
def _(t):
    p = V.phenology_pairs(roles.sim_phenology(t), roles.obs_phenology(t))
    return p.select(
        "PointID", "duration_obs", "duration_sim",
        (F.col("flowering_doy_sim") - F.col("flowering_doy")).alias("flowering_residual"),
        (F.col("duration_sim") - F.col("duration_obs")).alias("duration_residual"),
    )


@query("guarded_ratio", "PRJ-12", f"""
SELECT l_orderkey, l_linenumber, {rnd('l_extendedprice / nullif(l_discount, 0)', 4)} AS ratio FROM lineitem""")
def _(t):
    return rounded(t.lineitem.select(
        "l_orderkey", "l_linenumber", N.ratio("l_extendedprice", "l_discount").alias("ratio")
    ), 4)


@query("number_rows_after_sort", "PRJ-13", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS projectid FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return number_rows(df, ["o_custkey", "o_orderdate", "o_orderkey"], "projectid").select("o_orderkey", "projectid")


# -------------------------------------------------------------------- filters


@query("membership_filter", "FLT-1", """
SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size = 5""")
def _(t):
    return t.part.filter(F.col("p_type").isin("ECONOMY", "SMALL") & (F.col("p_size") == 5)).select(
        "p_partkey", "p_type", "p_size"
    )


_EVENTS4_SQL = """ev AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS sowing, min(CAST(l_shipdate AS DATE)) AS emergence,
         CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE max(CAST(l_shipdate AS DATE)) END AS maturity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate, o_custkey)"""


@query("valid_event_sequence", "FLT-2", f"""
WITH {_EVENTS4_SQL} SELECT * FROM ev WHERE sowing < emergence AND emergence < maturity""")
def _(t):
    ship = F.col("l_shipdate").cast("date")
    ev = (
        t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderkey", "o_orderdate", "o_custkey")
        .agg(F.min(ship).alias("emergence"), F.max(ship).alias("_m"))
        .select(
            F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("sowing"), "emergence",
            F.when(F.col("o_custkey") % 10 != 0, F.col("_m")).alias("maturity"),
        )
    )
    return R.valid_sequence(ev, ["sowing", "emergence", "maturity"])


@query("optional_flag_filter", "FLT-3", f"""
WITH {OBS_PHEN_SQL} SELECT PointID, flowering_doy FROM obs_phen WHERE valid_sequence""")
def _(t):
    return R.flagged_only(roles.obs_phenology(t), "valid_sequence").select("PointID", "flowering_doy")


@query("open_year_window", "FLT-4", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE year(o_orderdate) >= 1999""")
def _(t):
    return R.year_window(t.orders, "o_orderdate", first=1999).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("clamp_to_coverage", "FLT-5", """
WITH cov AS (SELECT min(CAST(l_shipdate AS DATE)) AS f, max(CAST(l_shipdate AS DATE)) AS l FROM lineitem),
w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 120 AS e FROM orders)
SELECT row_number() OVER (ORDER BY s, o_orderkey) AS projectid, o_orderkey, s AS start_date, e AS end_date
FROM w, cov WHERE s >= f AND e <= l""")
def _(t):
    cov = coverage(t.lineitem.withColumn("d", F.col("l_shipdate").cast("date")), [], "d")
    w = t.orders.select(
        F.lit(0).alias("projectid"), "o_orderkey", F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add("o_orderdate", 120).alias("end_date"),
    )
    return R.clamp_windows(w, "start_date", "end_date", cov, order=["start_date", "o_orderkey"], number="projectid")


@query("dropped_window_counts", "FLT-5 AGG-35", """
WITH cov AS (SELECT l_suppkey % 7 AS source, min(CAST(l_shipdate AS DATE)) + 90 AS f, max(CAST(l_shipdate AS DATE)) AS l
             FROM lineitem GROUP BY 1),
w AS (SELECT o_custkey % 7 AS source, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 120 AS e FROM orders)
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE s >= f AND e <= l) AS kept,
       count(*) FILTER (WHERE NOT (s >= f AND e <= l)) AS dropped
FROM w JOIN cov USING (source) GROUP BY 1""")
def _(t):
    src = t.lineitem.select((F.col("l_suppkey") % 7).alias("source"), F.col("l_shipdate").cast("date").alias("d"))
    cov = coverage(src, ["source"], "d").withColumn("first", F.date_add("first", 90))
    w = t.orders.select(
        (F.col("o_custkey") % 7).alias("source"), F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add("o_orderdate", 120).alias("end_date"),
    )
    return R.dropped_windows(w, "start_date", "end_date", cov, ["source"])


@query("quantile_outlier_filter", "FLT-6", f"""
WITH {PHEN_SQL},
q AS (SELECT STATE_NAME, quantile_cont(flowering_doy, 0.01) AS a1, quantile_cont(flowering_doy, 0.99) AS a2,
             quantile_cont(maturity_doy, 0.01) AS b1, quantile_cont(maturity_doy, 0.99) AS b2 FROM phen GROUP BY 1)
SELECT PointID, STATE_NAME, flowering_doy, maturity_doy FROM phen JOIN q USING (STATE_NAME)
WHERE flowering_doy BETWEEN a1 AND a2 AND maturity_doy BETWEEN b1 AND b2""")
def _(t):
    p = V.phenology_pairs(roles.sim_phenology(t), roles.obs_phenology(t))
    return R.quantile_filter(
        p.select("PointID", "STATE_NAME", "flowering_doy", "maturity_doy"),
        ["flowering_doy", "maturity_doy"], 0.01, 0.99, ["STATE_NAME"],
    )


@query("prior_year_anomaly", "FLT-7 FN-D2", f"""
WITH {SIM_PHEN_SQL}
SELECT PointID, harvest_year, coalesce(CASE WHEN PointID % 9 = 0 THEN NULL ELSE anthesis_year END < harvest_year, false) AS abnormal
FROM sim_phen""")
def _(t):
    sim = roles.sim_phenology(t)
    text = F.when(F.col("PointID") % 9 == 0, F.lit("no date")).otherwise(F.col("anthesis_date"))
    return R.flag_prior_year(sim, D.parse_day_month_year(text), "harvest_year").select("PointID", "harvest_year", "abnormal")


@query("drop_flagged_rows", "FLT-8", f"""
WITH {PHEN_SQL} SELECT PointID, site, harvest_year FROM phen_all WHERE NOT abnormal""")
def _(t):
    p = V.phenology_flagged(roles.sim_phenology(t), roles.obs_phenology(t))
    return R.drop_flagged(p, "abnormal", ["site"]).select("PointID", "site", "harvest_year")


@query("drop_flagged_places", "FLT-8", f"""
WITH {PHEN_SQL}
SELECT PointID, site, harvest_year FROM phen_all
WHERE site NOT IN (SELECT site FROM phen_all WHERE abnormal)""")
def _(t):
    p = V.phenology_flagged(roles.sim_phenology(t), roles.obs_phenology(t))
    return R.drop_flagged(p, "abnormal", ["site"], whole_key=True).select("PointID", "site", "harvest_year")


@query("drop_unusable_values", "FLT-9 FN-M5", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_custkey % 11 <> 0""")
def _(t):
    v = F.when(F.col("c_custkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return R.drop_unusable(t.customer.select("c_custkey", v.alias("c_acctbal")), ["c_acctbal"], ["c_acctbal"])


@query("truncate_at_maturity", "FLT-10 WIN-2 WIN-3", f"""
WITH {DAILY_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date) - 1 AS pos FROM daily WHERE dvs > 0),
f AS (SELECT *, min(CASE WHEN dvs >= 2 THEN pos END) OVER (PARTITION BY location) AS cut FROM p)
SELECT location, date, {rnd('dvs', 4)} AS dvs, {rnd('LAI_sim', 4)} AS LAI_sim FROM f WHERE cut IS NULL OR pos <= cut""")
def _(t):
    d = roles.daily_canopy(t).filter(F.col("dvs") > 0)
    return rounded(R.truncate_at(d, ["location"], ["date"], F.col("dvs") >= 2).select("location", "date", "dvs", "LAI_sim"), 4)


@query("positive_stage_filter", "FLT-11", f"""
WITH {DAILY_SQL} SELECT location, date, {rnd('dvs', 4)} AS dvs FROM daily WHERE dvs > 0""")
def _(t):
    return rounded(roles.daily_canopy(t).filter(F.col("dvs") > 0).select("location", "date", "dvs"), 4)


# ---------------------------------------------------------------------- joins


@query("pair_sim_and_obs", "JN-1", f"""
WITH {SIM_PHEN_SQL}, {OBS_PHEN_SQL}
SELECT PointID, harvest_year, flowering_doy_sim, flowering_doy FROM sim_phen JOIN obs_phen USING (PointID, harvest_year)""")
def _(t):
    return R.pair(roles.sim_phenology(t), roles.obs_phenology(t), ["PointID", "harvest_year"]).select(
        "PointID", "harvest_year", "flowering_doy_sim", "flowering_doy"
    )


PHASES_SQL = """rec AS (
  SELECT o_orderkey AS stations_id, CAST(year(o_orderdate) AS INTEGER) AS reference_year, 'sowing' AS phase,
         CAST(o_orderdate AS DATE) AS date, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
         CASE WHEN o_custkey % 2 = 0 THEN 'winter_wheat' ELSE 'maize' END AS object FROM orders
  UNION ALL
  SELECT l_orderkey, CAST(year(o_orderdate) AS INTEGER) + CASE WHEN o_custkey % 2 = 0 AND l_linenumber > 1 THEN 1 ELSE 0 END,
         CASE WHEN l_linenumber = 1 THEN 'emergence' WHEN l_linenumber = 2 THEN 'flowering'
              WHEN l_linenumber = 3 THEN 'maturity' ELSE 'harvest' END,
         CAST(l_shipdate AS DATE) + 30 * l_linenumber, CAST(dayofyear(CAST(l_shipdate AS DATE) + 30 * l_linenumber) AS INTEGER),
         CASE WHEN o_custkey % 2 = 0 THEN 'winter_wheat' ELSE 'maize' END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
shifted AS MATERIALIZED (
  SELECT stations_id, reference_year + CASE WHEN object = 'winter_wheat' AND phase IN ('sowing', 'emergence') THEN 1 ELSE 0 END AS harvest_year,
         phase, date, doy, object FROM rec),
chain AS (
  SELECT s.stations_id, s.harvest_year, s.object, s.date AS sowing_date, s.doy AS sowing_doy,
         e.date AS emergence_date, e.doy AS emergence_doy, f.date AS flowering_date, f.doy AS flowering_doy,
         m.date AS maturity_date, m.doy AS maturity_doy
  FROM (SELECT * FROM shifted WHERE phase = 'sowing') s
  JOIN (SELECT * FROM shifted WHERE phase = 'emergence') e USING (stations_id, harvest_year)
  JOIN (SELECT * FROM shifted WHERE phase = 'flowering') f USING (stations_id, harvest_year)
  JOIN (SELECT * FROM shifted WHERE phase IN ('maturity', 'harvest')) m USING (stations_id, harvest_year))"""


def phase_records(t):
    crop = F.when(F.col("o_custkey") % 2 == 0, "winter_wheat").otherwise("maize")
    sown = t.orders.select(
        F.col("o_orderkey").alias("stations_id"), F.year("o_orderdate").alias("reference_year"),
        F.lit("sowing").alias("phase"), F.col("o_orderdate").cast("date").alias("date"),
        F.dayofyear("o_orderdate").alias("doy"), crop.alias("object"),
    )
    day = F.date_add("l_shipdate", 30 * F.col("l_linenumber"))
    n = F.col("l_linenumber")
    later = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("stations_id"),
        (F.year("o_orderdate") + F.when((F.col("o_custkey") % 2 == 0) & (n > 1), 1).otherwise(0)).alias("reference_year"),
        F.when(n == 1, "emergence").when(n == 2, "flowering").when(n == 3, "maturity").otherwise("harvest").alias("phase"),
        day.alias("date"), F.dayofyear(day).alias("doy"), crop.alias("object"),
    )
    return sown.unionByName(later)


PHASES = {
    "sowing": ["sowing"], "emergence": ["emergence"], "flowering": ["flowering"], "maturity": ["maturity", "harvest"],
}


def seasons(t, skip=()):
    rec = phase_records(t).withColumn("harvest_year", D.harvest_year("reference_year", "object", "phase"))
    return R.chain_events(rec, ["stations_id", "harvest_year"], PHASES, carry={"sowing": ["object"]}, skip=skip)


@query("chain_phase_events", "JN-2 FN-D6", f"WITH {PHASES_SQL} SELECT * FROM chain")
def _(t):
    return seasons(t)


@query("chain_phase_events_without_flowering", "JN-2", f"""
WITH {PHASES_SQL}
SELECT s.stations_id, s.harvest_year, s.object, s.date AS sowing_date, s.doy AS sowing_doy,
       e.date AS emergence_date, e.doy AS emergence_doy, m.date AS maturity_date, m.doy AS maturity_doy
FROM (SELECT * FROM shifted WHERE phase = 'sowing') s
JOIN (SELECT * FROM shifted WHERE phase = 'emergence') e USING (stations_id, harvest_year)
JOIN (SELECT * FROM shifted WHERE phase IN ('maturity', 'harvest')) m USING (stations_id, harvest_year)""")
def _(t):
    return seasons(t, skip=["flowering"])


@query("attach_district_lookup", "JN-3", f"""
WITH {POINTS_SQL}, {SIM_SQL}
SELECT row_id, location, NUTS_NAME, STATE_NAME FROM sim LEFT JOIN (SELECT * FROM points WHERE STATE_NAME <> 'ASIA') USING (location)""")
def _(t):
    dim = roles.points(t).filter(F.col("STATE_NAME") != "ASIA").select("location", "NUTS_NAME", "STATE_NAME")
    return R.lookup(roles.sim_yearly(t).select("row_id", "location"), dim, ["location"])


@query("keep_member_points", "JN-4", """
SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 4e5)""")
def _(t):
    members = t.orders.filter(F.col("o_totalprice") > 4e5).select(F.col("o_custkey").alias("c_custkey"))
    return R.keep_members(t.customer.select("c_custkey", "c_nationkey"), members, ["c_custkey"])


@query("missing_required_keys", "JN-5 SET-3", """
SELECT DISTINCT o_custkey AS location FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    have = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("location"))
    return R.missing_keys(t.orders.select(F.col("o_custkey").alias("location")), have, ["location"])


@query("first_missing_keys", "JN-5", """
SELECT DISTINCT l_suppkey AS location FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5e3) ORDER BY 1 LIMIT 10""")
def _(t):
    have = t.supplier.filter(F.col("s_acctbal") > 5e3).select(F.col("s_suppkey").alias("location"))
    return R.missing_keys(t.lineitem.select(F.col("l_suppkey").alias("location")), have, ["location"]).orderBy("location").limit(10)


@query("locations_by_events", "JN-7 SRC-12", """
WITH ev(Event, vType, DVS, Amount) AS (VALUES (1, 'PK', 1e-3, 40e0), (2, 'KAS', 25e-2, 32e0), (3, 'KAS', 4e-1, 16e0), (4, 'KAS', 9e-1, 16e0))
SELECT location, 2 AS FertilizerScenario, 'winter_wheat' AS crop, CAST(Event AS INTEGER) AS Event, vType, DVS, Amount
FROM (SELECT DISTINCT o_custkey AS location FROM orders), ev""")
def _(t):
    from ..operators.scenario import fertiliser_table

    return fertiliser_table(t.orders.select(F.col("o_custkey").alias("vLocationID")), "winter_wheat")


@query("monthly_value_on_daily_rows", "JN-13", f"""
WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, avg(o_totalprice) AS co2 FROM orders GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS date, {rnd('co2', 4)} AS co2
FROM lineitem JOIN m ON year(l_shipdate) = y AND month(l_shipdate) = mo""")
def _(t):
    monthly = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
        F.avg("o_totalprice").alias("co2")
    )
    daily = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"),
        F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"),
    )
    return rounded(R.lookup(daily, monthly, ["y", "m"], "inner").drop("y", "m"), 4)


@query("months_without_a_value", "JN-13 SET-3", """
WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo FROM orders)
SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS mo FROM lineitem
EXCEPT SELECT y, mo FROM m""")
def _(t):
    have = t.orders.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo"))
    need = t.lineitem.select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("mo"))
    return R.missing_keys(need, have, ["y", "mo"])


@query("applied_nutrients", "JN-14", f"""
WITH comp AS (SELECT p_type AS Fertilizertype, avg(p_size) / 1e2 AS Nitrate, avg(p_retailprice) / 1e4 AS Phosphorus FROM part GROUP BY 1),
ev AS (SELECT l_orderkey AS location, l_linenumber AS Event, p_type AS vType, l_quantity AS Amount FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT location, Event, vType, {rnd('sum(Amount)', 4)} AS amount, {rnd('sum(Amount * Nitrate)', 4)} AS nitrate, {rnd('sum(Amount * Phosphorus)', 4)} AS phosphorus
FROM ev JOIN comp ON vType = Fertilizertype GROUP BY 1, 2, 3""")
def _(t):
    from ..operators.scenario import nutrients

    comp = t.part.groupBy(F.col("p_type").alias("Fertilizertype")).agg(
        (F.avg("p_size") / 100.0).alias("Nitrate"), (F.avg("p_retailprice") / 10000.0).alias("Phosphorus")
    )
    ev = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("location"), F.col("l_linenumber").alias("Event"), F.col("p_type").alias("vType"),
        F.col("l_quantity").alias("Amount"),
    )
    out = nutrients(ev, comp, ["Nitrate", "Phosphorus"]).groupBy("location", "Event", "vType").agg(
        F.sum("Amount").alias("amount"), F.sum("applied_Nitrate").alias("nitrate"), F.sum("applied_Phosphorus").alias("phosphorus")
    )
    return rounded(out, 4)


@query("attach_admin_columns", "JN-16", f"""
WITH {SIM_SQL}, a AS (SELECT DISTINCT c_custkey AS location, n_name AS state FROM customer JOIN nation ON c_nationkey % 20 = n_nationkey % 20)
SELECT row_id, location, state FROM sim JOIN a USING (location)""")
def _(t):
    admin = t.customer.join(t.nation, F.col("c_nationkey") % 20 == F.col("n_nationkey") % 20)
    return R.attach_admin(
        roles.sim_yearly(t).select("row_id", "location"), admin, "location", {"c_custkey": "location", "n_name": "state"}
    )


# ----------------------------------------------------------- sets and reshaping


@query("union_with_part_keys", "SET-1", """
SELECT o_custkey AS location, o_totalprice AS value, NULL::VARCHAR AS flag, 'orders' AS part FROM orders
UNION ALL SELECT l_suppkey, l_extendedprice, l_returnflag, 'lineitem' FROM lineitem""")
def _(t):
    return R.union_tagged({
        "orders": t.orders.select(F.col("o_custkey").alias("location"), F.col("o_totalprice").alias("value")),
        "lineitem": t.lineitem.select(
            F.col("l_suppkey").alias("location"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("flag")
        ),
    }, "part")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_BY_SEGMENT = ", ".join(f"""{rnd(f"avg(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END)", 4)} AS "{s}" """ for s in _SEGMENTS)
_BY_LINE = ", ".join(f"""{rnd(f"avg(CASE WHEN l_linenumber = {k} THEN l_quantity END)", 4)} AS "{k}" """ for k in range(1, 8))


@query("pivot_by_scale", "SET-4", f"SELECT c_nationkey AS district, {_BY_SEGMENT} FROM customer GROUP BY 1")
def _(t):
    m = t.customer.groupBy(F.col("c_nationkey").alias("district"), "c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    return rounded(R.pivot_wide(m, ["district"], "c_mktsegment", "v", _SEGMENTS), 4)


@query("wide_series_by_point", "SET-5", f"SELECT CAST(l_shipdate AS DATE) AS date, {_BY_LINE} FROM lineitem GROUP BY 1")
def _(t):
    long = t.lineitem.groupBy(
        F.col("l_shipdate").cast("date").alias("date"), "l_linenumber"
    ).agg(F.avg("l_quantity").alias("v"))
    return rounded(R.pivot_wide(long, ["date"], "l_linenumber", "v", list(range(1, 8))), 4)


@query("flatten_parameter_lists", "SET-6", """
SELECT vec_id, concat('w_', CAST(i - 1 AS VARCHAR)) AS flat_name, CAST(i - 1 AS INTEGER) AS idx, embedding[i] AS value
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""")
def _(t):
    df = t.embeddings.withColumn("name", F.lit("w"))
    return R.flatten_lists(df, ["vec_id"], "name", "embedding").select("vec_id", "flat_name", "idx", "value")


@query("unflatten_parameter_lists", "SET-6", """
SELECT set_id, 'q' AS name, list(value ORDER BY idx) AS "values" FROM (
  SELECT l_orderkey AS set_id, l_linenumber AS idx, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    el = t.lineitem.groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("idx")).agg(
        F.max("l_quantity").alias("value")
    ).withColumn("name", F.lit("q"))
    return R.unflatten_lists(el, ["set_id"], "name")


@query("metrics_as_rows", "SET-7", f"""
WITH m AS (SELECT l_returnflag, {rnd('avg(l_quantity)', 4)} AS q, {rnd('avg(l_discount)', 4)} AS d FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'quantity' AS name, q AS value FROM m UNION ALL SELECT l_returnflag, 'discount', d FROM m""")
def _(t):
    m = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return rounded(R.to_long(m, ["l_returnflag"], ["quantity", "discount"]), 4)


@query("stack_two_stages", "SET-8", f"""
WITH {PHEN_SQL}
SELECT PointID, 'flowering_doy' AS name, CAST(flowering_doy AS DOUBLE) AS value FROM phen
UNION ALL SELECT PointID, 'maturity_doy', CAST(maturity_doy AS DOUBLE) FROM phen""")
def _(t):
    p = V.phenology_pairs(roles.sim_phenology(t), roles.obs_phenology(t))
    return R.to_long(p, ["PointID"], ["flowering_doy", "maturity_doy"])


@query("set_difference_of_keys", "SET-3", """
SELECT c_custkey AS location FROM customer EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996""")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("location")).subtract(
        t.orders.filter(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("location"))
    )


# ---------------------------------------------------- sort, top-k, sample, dedup


@query("mixed_direction_sort", "SRT-1", """
SELECT c_nationkey, n, rank() OVER (ORDER BY n DESC, c_nationkey) AS position FROM (
  SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)""")
def _(t):
    n = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return number_rows(n, [F.col("n").desc(), F.col("c_nationkey")], "position")


@query("location_contiguous_layout", "SRT-2", """
WITH r AS (SELECT o_custkey AS location, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT location, count(*) AS n_rows, true AS contiguous, CAST(sum(place * (k % 1009)) AS BIGINT) AS order_digest FROM r GROUP BY 1""")
def _(t):
    df = t.orders.select(F.col("o_custkey").alias("location"), "o_orderdate", F.col("o_orderkey").alias("k"))
    laid = S.contiguous_layout(df, "location", ["o_orderdate", "k"])
    # Numbers of a row as it lies in the layout; the places in a location must be those of its sorted rows.
    marked = stage(laid.select("location", "k", F.monotonically_increasing_id().alias("at")), "layout")
    place = F.row_number().over(Window.partitionBy("location").orderBy("at"))
    per = marked.withColumn("place", place).groupBy("location", F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.col("place") * (F.col("k") % 1009)).alias("digest")
    )
    return per.groupBy("location").agg(
        F.sum("n").alias("n_rows"), F.every(F.col("b") - F.col("a") + 1 == F.col("n")).alias("contiguous"), F.sum("digest").alias("order_digest"),
    )


@query("chunked_parameter_lists", "SET-6", """
SELECT 'all' AS name, (event_id - lo) // 500 AS chunk, count(*) AS n, CAST(sum(value * ((event_id - lo) % 500 + 1)) AS BIGINT) AS weighted FROM (
  SELECT event_id, value, min(event_id) OVER () AS lo FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS value FROM events)) GROUP BY 2""")
def _(t):
    first = t.events.agg(F.min("event_id")).first()[0] or 0
    el = t.events.select(F.lit("all").alias("name"), (F.col("event_id") - first).alias("idx"), F.floor("value").alias("value"))
    # One parameter with as many values as events.
    lists = R.chunked_lists(el, [], "name", chunk=500)
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.select("name", "chunk", F.size("values").cast("long").alias("n"), weighted.alias("weighted"))


_CLIMATE_SQL = """clim AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'DWD' WHEN 1 THEN 'HYRAS_OBS' WHEN 2 THEN 'MIROC6_historical'
  WHEN 3 THEN 'MIROC6_ssp126' ELSE 'CanESM5_ssp370' END AS climate FROM customer)"""


def _climates(t):
    k = F.col("c_custkey") % 5
    name = (
        F.when(k == 0, "DWD").when(k == 1, "HYRAS_OBS").when(k == 2, "MIROC6_historical")
        .when(k == 3, "MIROC6_ssp126").otherwise("CanESM5_ssp370")
    )
    return t.customer.select("c_custkey", name.alias("climate"))


@query("climate_category_order", "SRT-3 FN-C1", f"""
WITH {_CLIMATE_SQL}, g AS (SELECT climate, count(*) AS n,
  CASE WHEN climate = 'DWD' THEN 0 WHEN climate LIKE '%\\_historical' ESCAPE '\\' OR climate = 'HYRAS_OBS' THEN 1 ELSE 2 END AS k FROM clim GROUP BY 1)
SELECT climate, n, CASE k WHEN 0 THEN 'Baseline (DWD obs.)' WHEN 1 THEN 'Historical' ELSE 'Future' END AS climate_group,
       row_number() OVER (ORDER BY k, climate <> 'HYRAS_OBS', climate) AS position FROM g""")
def _(t):
    g = _climates(t).groupBy("climate").agg(F.count(F.lit(1)).alias("n"), F.first(X.climate_group("climate")).alias("climate_group"))
    return number_rows(g.withColumn("o", X.climate_order("climate")), ["o"], "position").drop("o")


@query("worst_locations", "TOP-1", f"""
WITH {PHEN_SQL}, m AS (SELECT site, quantile_cont(flowering_doy_sim - flowering_doy, 0.5) AS bias FROM phen GROUP BY 1)
SELECT site, bias FROM m ORDER BY abs(bias) DESC, site LIMIT 8""")
def _(t):
    from ..operators.aggregates import bias_table

    p = V.phenology_pairs(roles.sim_phenology(t), roles.obs_phenology(t))
    per = bias_table(p, ["site"], {"flowering": ("flowering_doy", "flowering_doy_sim")})
    return R.top_abs(per.select("site", F.col("flowering_bias").alias("bias")), "bias", 8, ["site"])


@query("worst_years", "TOP-2", f"""
WITH {PAIRS_SQL}, y AS (SELECT year, avg(yield_sim) - avg(yield) AS bias FROM pairs GROUP BY 1)
SELECT year, {rnd('bias')} AS bias FROM y ORDER BY abs(bias) DESC, year LIMIT 6""")
def _(t):
    from ..operators.aggregates import temporal_decomposition

    y = temporal_decomposition(roles.yield_pairs(t), "year", "yield", "yield_sim")
    return rounded(R.top_abs(y.select("year", "bias"), "bias", 6, ["year"]))


@query("most_sampled_seasons", "TOP-3", """
SELECT l_suppkey AS location, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2
ORDER BY n DESC, location, year LIMIT 6""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("location"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return R.top_abs(n, "n", 6, ["location", "year"])


_DRAW = "(p_partkey * 7919) % 10007"


@query("stratified_two_phase_sample", "SMP-1 SRC-14", f"""
WITH r AS (SELECT p_partkey // 50 AS row_no, p_partkey % 50 AS col_no, p_size AS crop_id, p_partkey, p_partkey // 1000 AS block,
                  {_DRAW} AS draw FROM part WHERE p_size NOT IN (0, 50)),
a AS (SELECT *, row_number() OVER (PARTITION BY block, crop_id ORDER BY draw, p_partkey) AS k FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY draw, p_partkey) AS k2 FROM a WHERE k <= 10)
SELECT crop_id, row_no, col_no FROM b WHERE k2 <= 15""")
def _(t):
    raster = t.part.filter(~F.col("p_size").isin(0, 50)).select(
        F.floor(F.col("p_partkey") / 50).alias("row_no"), (F.col("p_partkey") % 50).alias("col_no"),
        F.col("p_size").alias("crop_id"), "p_partkey", F.floor(F.col("p_partkey") / 1000).alias("block"),
    )
    draw = [(F.col("p_partkey") * 7919) % 10007, F.col("p_partkey")]
    return S.stratified_two_phase(raster, "block", "crop_id", ["p_partkey"], 10, 15, order=draw).select(
        "crop_id", "row_no", "col_no"
    )


@query("stratified_sample_hash_draw", "SMP-1", """
WITH b AS (SELECT p_size, p_partkey // 1000 AS block, least(count(*), 100) AS n FROM part GROUP BY 1, 2)
SELECT p_size AS crop_id, CAST(least(sum(n), 500) AS BIGINT) AS n FROM b GROUP BY 1""")
def _(t):
    raster = t.part.select(F.col("p_size").alias("crop_id"), "p_partkey", F.floor(F.col("p_partkey") / 1000).alias("block"))
    return S.stratified_two_phase(raster, "block", "crop_id", ["p_partkey"]).groupBy("crop_id").agg(F.count(F.lit(1)).alias("n"))


@query("rows_of_first_groups", "SMP-2", """
WITH f AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_orderkey), 1 LIMIT 3)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f)""")
def _(t):
    return S.first_groups(t.orders, "o_custkey", 3, "o_orderkey").select("o_orderkey", "o_custkey")


@query("evenly_spaced_locations", "SMP-3 SRC-2", """
WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)),
i AS (SELECT DISTINCT CASE WHEN i = 39 THEN (SELECT max(n) - 1 FROM k) ELSE CAST(floor(i * ((SELECT max(n) - 1 FROM k) / 39e0)) AS BIGINT) END AS pos
      FROM range(40) t(i))
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM k WHERE r IN (SELECT pos FROM i))""")
def _(t):
    return S.evenly_spaced(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 40)


@query("keep_first_per_key", "DED-1", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def _(t):
    df = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.first_per_key(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("whole_row_distinct", "DED-1", """
SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem""")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("balanced_location_ranges", "BAL-1", """
WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)),
b AS (SELECT o_custkey, CAST(((r + 1) * 13 - 1) // n AS INTEGER) AS bucket FROM k)
SELECT bucket, min(o_custkey) AS first_key, max(o_custkey) AS last_key, count(DISTINCT o_custkey) AS n_keys, count(*) AS n_rows
FROM orders JOIN b USING (o_custkey) GROUP BY 1""")
def _(t):
    b = S.balanced_buckets(t.orders.select("o_custkey"), "o_custkey", 13)
    return S.bucket_ranges(b, "o_custkey")


