"""Queries for aggregates and agreement metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import relational as R
from ..plans import views as V
from ..session import stage
from . import roles
from .registry import query, rnd, rounded
from .roles import CANOPY_SQL, PAIRS_SQL, PHEN_SQL, POINTS_SQL, SIM_SQL, STAGE_EDGES


def phen(t):
    return V.phenology_pairs(roles.sim_phenology(t), roles.obs_phenology(t))


def canopy(t):
    return V.canopy_pairs(roles.daily_canopy(t), roles.obs_canopy(t))


def bin_sql(x: str, edges=STAGE_EDGES) -> str:
    arms = " ".join(f"WHEN {x} <= {e} THEN {i}" for i, e in enumerate(edges[1:]))
    return f"CAST(CASE WHEN {x} < {edges[0]} THEN NULL {arms} END AS INTEGER)"


def metric_sql(o: str, s: str) -> str:
    """The full metric set over finite pairs o, s of the current FROM."""
    return f"""count(*) AS n,
  CASE WHEN count(*) >= 2 THEN {rnd(f'sqrt(avg(({s}-{o})*({s}-{o})))')} END AS rmse,
  CASE WHEN count(*) >= 2 THEN {rnd(f'avg(abs({s}-{o}))')} END AS mae,
  CASE WHEN count(*) >= 2 THEN {rnd(f'avg({s}-{o})')} END AS bias,
  CASE WHEN count(*) >= 2 THEN {rnd(f'pow(covar_pop({s},{o})/nullif(stddev_pop({s})*stddev_pop({o}),0),2)')} END AS r2,
  CASE WHEN count(*) >= 2 THEN {rnd(f'100*sqrt(avg(({s}-{o})*({s}-{o})))/nullif(avg({o}),0)')} END AS nrmse_pct,
  CASE WHEN count(*) >= 2 AND var_pop({o}) > 0 THEN {rnd(f'1-avg(({s}-{o})*({s}-{o}))/nullif(var_pop({o}),0)')} END AS ef"""


def corr_sql(o: str, s: str) -> str:
    return f"""count(*) AS n,
  CASE WHEN count(*) >= 2 THEN {rnd(f'covar_pop({s},{o})/nullif(stddev_pop({s})*stddev_pop({o}),0)')} END AS r,
  {rnd(f'sqrt(avg(({s}-{o})*({s}-{o})))')} AS rmse, {rnd(f'100*sqrt(avg(({s}-{o})*({s}-{o})))/nullif(avg({o}),0)')} AS nrmse_pct,
  {rnd(f'avg({s}-{o})')} AS bias, {rnd(f'avg(abs({s}-{o}))')} AS mae"""


# ---------------------------------------------------------------- plain groups


@query("district_year_means", "AGG-1", f"""
WITH {PAIRS_SQL}
SELECT NUTS_ID, year, {rnd('avg(yield_sim)')} AS yield_sim, {rnd('avg(biomass)')} AS biomass, count(DISTINCT location) AS n_points
FROM sim JOIN points USING (location) GROUP BY 1, 2""")
def _(t):
    sim = roles.sim_yearly(t).join(roles.points(t).select("location", "NUTS_ID"), "location")
    return rounded(A.district_year(sim, ["NUTS_ID", "year"], ["yield_sim", "biomass"], "location"))


@query("district_climatology", "AGG-2", f"""
WITH {PAIRS_SQL} SELECT NUTS_ID, {rnd('avg(yield)')} AS yield, {rnd('avg(yield_sim)')} AS yield_sim FROM pairs GROUP BY 1""")
def _(t):
    return rounded(A.climatology(roles.yield_pairs(t), ["NUTS_ID"], ["yield", "yield_sim"]))


@query("means_by_state", "AGG-3", f"""
WITH {PHEN_SQL}
SELECT STATE_NAME, {rnd('avg(flowering_doy)')} AS flowering_doy, {rnd('avg(flowering_doy_sim)')} AS flowering_doy_sim,
       {rnd('avg(maturity_doy)')} AS maturity_doy, {rnd('avg(maturity_doy_sim)')} AS maturity_doy_sim
FROM phen GROUP BY 1 ORDER BY 1""")
def _(t):
    return rounded(A.climatology(phen(t), ["STATE_NAME"], [
        "flowering_doy", "flowering_doy_sim", "maturity_doy", "maturity_doy_sim"
    ])).orderBy("STATE_NAME")


@query("mean_and_sd_by_year", "AGG-4", f"""
WITH {PAIRS_SQL}
SELECT year, {rnd('avg(yield)')} AS yield_mean, {rnd('stddev_samp(yield)')} AS yield_sd,
       {rnd('avg(yield_sim)')} AS yield_sim_mean, {rnd('stddev_samp(yield_sim)')} AS yield_sim_sd FROM pairs GROUP BY 1""")
def _(t):
    return rounded(A.mean_and_sd(roles.yield_pairs(t), ["year"], ["yield", "yield_sim"]))


@query("category_overview_in_order", "AGG-5", f"""
WITH o(position, c_mktsegment) AS (VALUES (0, 'MACHINERY'), (1, 'BUILDING'), (2, 'UNSEEN'), (3, 'HOUSEHOLD'))
SELECT CAST(position AS INTEGER) AS position, c_mktsegment, {rnd('avg(c_acctbal)', 4)} AS mean FROM o LEFT JOIN customer USING (c_mktsegment) GROUP BY 1, 2""")
def _(t):
    m = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))
    return rounded(R.in_given_order(m, "c_mktsegment", ["MACHINERY", "BUILDING", "UNSEEN", "HOUSEHOLD"]), 4)


@query("district_median_with_fallback", "AGG-6", """
WITH m AS (SELECT c_nationkey AS d, CAST(round_even(quantile_cont(dayofyear(o_orderdate), 0.5), 0) AS INTEGER) AS day
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (3, 7, 11) GROUP BY 1),
g AS (SELECT CAST(round_even(quantile_cont(dayofyear(o_orderdate), 0.5), 0) AS INTEGER) AS day
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (3, 7, 11))
SELECT c_custkey, c_nationkey AS d, coalesce(m.day, g.day) AS day FROM customer LEFT JOIN m ON c_nationkey = d CROSS JOIN g""")
def _(t):
    base = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter(~F.col("c_nationkey").isin(3, 7, 11)).select(
        F.col("c_nationkey").alias("d"), F.dayofyear("o_orderdate").alias("doy")
    )
    per, overall = A.group_median_or_global(base, ["d"], "doy", "day")
    pts = t.customer.select("c_custkey", F.col("c_nationkey").alias("d"))
    return pts.join(per, "d", "left").crossJoin(F.broadcast(overall)).select(
        "c_custkey", "d", F.coalesce("day", "global_value").alias("day")
    )


@query("station_median_calendar", "AGG-7", """
SELECT o_custkey, CAST(round_even(quantile_cont(dayofyear(o_orderdate), 0.5), 0) AS INTEGER) AS sowing_doy FROM orders GROUP BY 1""")
def _(t):
    d = t.orders.select("o_custkey", F.dayofyear("o_orderdate").alias("sowing_doy"))
    return A.station_medians(d, ["o_custkey"], ["sowing_doy"])


@query("abnormal_places", "AGG-8 AGG-9", f"""
WITH {PHEN_SQL}
SELECT site, count(DISTINCT CASE WHEN abnormal THEN harvest_year END) AS n_abnormal_years,
       min(CASE WHEN abnormal THEN harvest_year END) AS first_abnormal_year, max(CASE WHEN abnormal THEN harvest_year END) AS last_abnormal_year,
       count(DISTINCT harvest_year) AS total_years,
       round_even(count(DISTINCT CASE WHEN abnormal THEN harvest_year END) / CAST(count(DISTINCT harvest_year) AS DOUBLE), 3) AS abnormal_fraction
FROM phen_all GROUP BY 1 HAVING count(DISTINCT CASE WHEN abnormal THEN harvest_year END) > 0""")
def _(t):
    p = V.phenology_flagged(roles.sim_phenology(t), roles.obs_phenology(t))
    return A.abnormal_summary(p, "abnormal", ["site"], "harvest_year")


# --------------------------------------------------------------------- metrics


@query("rmse_by_line", "AGG-10", f"""
SELECT l_linenumber, {rnd('sqrt(avg(pow(l_quantity - l_extendedprice / 2e3, 2)))')} AS rmse FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(t.lineitem.groupBy("l_linenumber").agg(
        M.rmse(F.col("l_extendedprice") / 2000.0, "l_quantity").alias("rmse")
    ))


@query("phenology_loss", "AGG-11 PIP-11", f"""
WITH {PHEN_SQL}, m AS (
SELECT sqrt(avg(pow(flowering_doy_sim - flowering_doy, 2))) AS f, sqrt(avg(pow(maturity_doy_sim - maturity_doy, 2))) AS m,
       avg(flowering_doy_sim - flowering_doy) AS fb, avg(maturity_doy_sim - maturity_doy) AS mb, count(*) AS n, count(DISTINCT PointID) AS locations FROM phen)
SELECT {rnd('(f + m) / 2')} AS loss, {rnd('f')} AS flowering_rmse, {rnd('fb')} AS flowering_bias, {rnd('m')} AS maturity_rmse,
       {rnd('mb')} AS maturity_bias, n, locations FROM m""")
def _(t):
    return rounded(V.phenology_loss(phen(t)))


@query("phenology_score_with_exclusions", "AGG-11 PIP-11 ASR-2", f"""
WITH {PHEN_SQL}, m AS (
SELECT sqrt(avg(pow(flowering_doy_sim - flowering_doy, 2))) AS f, sqrt(avg(pow(maturity_doy_sim - maturity_doy, 2))) AS m,
       avg(flowering_doy_sim - flowering_doy) AS fb, avg(maturity_doy_sim - maturity_doy) AS mb, count(*) AS n, count(DISTINCT PointID) AS locations FROM phen)
SELECT {rnd('(f + m) / 2')} AS loss, {rnd('f')} AS flowering_rmse, {rnd('fb')} AS flowering_bias, {rnd('m')} AS maturity_rmse,
       {rnd('mb')} AS maturity_bias, n, locations, (SELECT count(*) FROM sim_phen WHERE anthesis_year < harvest_year) AS excluded FROM m""")
def _(t):
    return rounded(V.phenology_score(roles.sim_phenology(t), roles.obs_phenology(t)))


@query("agreement_overall", "AGG-12", f"WITH {PAIRS_SQL} SELECT {metric_sql('yield', 'yield_sim')} FROM pairs")
def _(t):
    return rounded(M.agreement(roles.yield_pairs(t), "yield", "yield_sim"))


@query("agreement_by_group", "AGG-12 FN-M5", f"""
WITH p AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS o, l_extendedprice / 2e3 AS s FROM lineitem),
q AS (SELECT l_suppkey, o, s FROM p WHERE o IS NOT NULL AND s IS NOT NULL)
SELECT l_suppkey, {metric_sql('o', 's')} FROM q GROUP BY 1""")
def _(t):
    p = t.lineitem.select(
        "l_suppkey", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("o"),
        (F.col("l_extendedprice") / 2000.0).alias("s"),
    )
    return rounded(M.agreement(p, "o", "s", ["l_suppkey"]))


@query("yield_metric_set", "AGG-13", f"""
WITH {PAIRS_SQL} SELECT STATE_NAME, {corr_sql('yield', 'yield_sim')} FROM pairs GROUP BY 1""")
def _(t):
    return rounded(M.correlation_metrics(roles.yield_pairs(t), "yield", "yield_sim", ["STATE_NAME"]))


@query("stage_binned_loss", "AGG-14 FN-B1", f"""
WITH {CANOPY_SQL}, b AS (SELECT {bin_sql('dvs')} AS stage_bin, year, avg(LAI) AS o, avg(LAI_sim) AS s FROM canopy GROUP BY 1, 2)
SELECT {rnd('sqrt(avg(pow(s - o, 2)))')} AS loss, {rnd('avg(s - o)')} AS bias, count(*) AS n_groups FROM b WHERE stage_bin IS NOT NULL""")
def _(t):
    return rounded(M.binned_loss(canopy(t), "dvs", STAGE_EDGES, ["year"], "LAI", "LAI_sim"))


TWO_DIM_SQL = f"""y AS (SELECT sqrt(avg(pow(s - o, 2))) AS r FROM (SELECT avg(yield) AS o, avg(yield_sim) AS s FROM pairs GROUP BY year)),
z AS (SELECT sqrt(avg(pow(s - o, 2))) AS r FROM (SELECT avg(yield) AS o, avg(yield_sim) AS s FROM pairs GROUP BY STATE_NAME)),
w AS (SELECT sqrt(avg(pow(yield_sim - yield, 2))) AS r, avg(yield_sim - yield) AS b, avg(yield) AS mo, avg(yield_sim) AS ms, count(*) AS n FROM pairs)"""


@query("two_dimension_loss", "AGG-15 PIP-13", f"""
WITH {PAIRS_SQL}, {TWO_DIM_SQL}
SELECT {rnd('(y.r + z.r) / 2')} AS loss, {rnd('y.r')} AS rmse_year, {rnd('z.r')} AS "rmse_STATE_NAME", {rnd('w.r')} AS rmse_raw,
       {rnd('b')} AS bias, {rnd('mo')} AS mean_obs, {rnd('ms')} AS mean_sim, n FROM y, z, w""")
def _(t):
    return rounded(V.yield_loss(roles.yield_pairs(t)))


@query("harvest_index_medians", "AGG-16", f"""
WITH {PAIRS_SQL}
SELECT {rnd('quantile_cont(yield_sim / biomass, 0.5)')} AS hi_sim, {rnd('quantile_cont(yield / biomass, 0.5)')} AS hi_required,
       {rnd('quantile_cont(yield_sim / biomass, 0.5) - quantile_cont(yield / biomass, 0.5)')} AS hi_bias, {rnd('avg(biomass)')} AS mean_biomass
FROM pairs WHERE biomass > 0""")
def _(t):
    return rounded(V.harvest_index_medians(roles.staged_yield_pairs(t)))


@query("translocated_metrics", "AGG-17", f"""
WITH {PAIRS_SQL}
SELECT {rnd('avg(translocated)')} AS mean_translocated, {rnd('sqrt(avg(pow(translocated - yield, 2)))')} AS rmse_translocated,
       {rnd('avg(translocated) / avg(yield_sim)')} AS translocated_ratio FROM pairs""")
def _(t):
    return rounded(V.yield_translocation(roles.yield_pairs(t)))


@query("scaled_objective", "AGG-18", f"""
WITH l AS (SELECT l_returnflag AS component, sqrt(avg(pow(l_quantity - l_extendedprice / 2e3, 2))) AS loss FROM lineitem GROUP BY 1),
c(component, weight, scale) AS (VALUES ('A', 5e-1, 15e-2), ('N', 5e-1, 5e-1), ('R', 1e0, 2e0)),
p AS (SELECT component, loss, scale, weight, loss / scale AS scaled, weight * loss / scale AS contribution FROM c JOIN l USING (component))
SELECT component, {rnd('loss')} AS loss, scale, weight, {rnd('scaled')} AS scaled, {rnd('contribution')} AS contribution,
       {rnd('(SELECT sum(contribution) / sum(weight) FROM p)')} AS objective, {rnd('contribution / (SELECT sum(contribution) FROM p)')} AS share FROM p""")
def _(t):
    losses = t.lineitem.groupBy(F.col("l_returnflag").alias("component")).agg(
        M.rmse(F.col("l_extendedprice") / 2000.0, "l_quantity").alias("loss")
    )
    comp = t.spark.createDataFrame(
        [("A", 0.5, 0.15), ("N", 0.5, 0.5), ("R", 1.0, 2.0)], "component string, weight double, scale double"
    )
    return rounded(M.combine(losses, comp))


_RES = {"flowering": ("flowering_doy", "flowering_doy_sim"), "maturity": ("maturity_doy", "maturity_doy_sim"),
        "duration": ("duration_obs", "duration_sim")}


@query("bias_table_by_year", "AGG-19", f"""
WITH {PHEN_SQL}
SELECT harvest_year, count(*) AS n, quantile_cont(flowering_doy_sim - flowering_doy, 0.5) AS flowering_bias,
       quantile_cont(maturity_doy_sim - maturity_doy, 0.5) AS maturity_bias, quantile_cont(duration_sim - duration_obs, 0.5) AS duration_bias
FROM phen GROUP BY 1""")
def _(t):
    return A.bias_table(phen(t), ["harvest_year"], _RES)


@query("stage_bin_table", "AGG-20", f"""
WITH {CANOPY_SQL}
SELECT {bin_sql('dvs')} AS stage_bin, count(*) AS n, {rnd('avg(LAI)')} AS obs_mean, {rnd('avg(LAI_sim)')} AS sim_mean, {rnd('avg(LAI_sim - LAI)')} AS bias,
       {rnd('sqrt(avg(pow(LAI_sim - LAI, 2)))')} AS rmse, {rnd('100 * avg(LAI_sim - LAI) / nullif(avg(LAI), 0)')} AS rel_bias_pct
FROM canopy WHERE {bin_sql('dvs')} IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(A.stage_bin_table(canopy(t), "dvs", STAGE_EDGES, "LAI", "LAI_sim"))


@query("residual_overview", "AGG-21 AGG-22", f"""
WITH {CANOPY_SQL}
SELECT {rnd('avg(LAI_sim - LAI)')} AS mean_residual, {rnd('stddev_samp(LAI_sim - LAI)')} AS residual_sd,
       {rnd('regr_slope(LAI_sim - LAI, dvs)')} AS vs_stage_slope, {rnd('regr_slope(LAI_sim - LAI, LAI)')} AS vs_obs_slope FROM canopy""")
def _(t):
    return rounded(A.residual_overview(canopy(t), "LAI", "LAI_sim", "dvs"))


@query("residual_by_month", "AGG-21", f"""
SELECT CAST(month(l_shipdate) AS INTEGER) AS month, {rnd('avg(l_extendedprice / 2e3 - l_quantity)')} AS mean, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    df = t.lineitem.select("l_shipdate", "l_quantity", (F.col("l_extendedprice") / 2000.0).alias("s"))
    return rounded(A.residual_by_month(df, "l_shipdate", "l_quantity", "s"))


@query("place_bias_spread", "AGG-21", f"""
WITH {CANOPY_SQL}, p AS (SELECT location, avg(LAI_sim - LAI) AS b FROM canopy GROUP BY 1)
SELECT {rnd('quantile_cont(b, 0.25)')} AS bias_q25, {rnd('quantile_cont(b, 0.75)')} AS bias_q75,
       {rnd('100 * avg(CASE WHEN b > 0 THEN 1e0 ELSE 0e0 END)')} AS biased_high_pct FROM p""")
def _(t):
    return rounded(A.place_bias_spread(canopy(t), "location", "LAI", "LAI_sim"))


@query("guarded_slopes", "AGG-22", f"""
SELECT l_orderkey, CASE WHEN count(*) >= 3 AND max(l_quantity) > min(l_quantity) THEN {rnd('regr_slope(l_extendedprice, l_quantity)', 3)} END AS slope
FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(t.lineitem.groupBy("l_orderkey").agg(N.ols_slope("l_extendedprice", "l_quantity").alias("slope")), 3)


@query("residual_drivers", "AGG-23", f"""
WITH {PAIRS_SQL}, l AS (
  SELECT 'biomass' AS driver, biomass AS level, yield_sim - yield AS r FROM pairs UNION ALL SELECT 'tranrf', tranrf, yield_sim - yield FROM pairs)
SELECT driver, count(*) AS n, {rnd('corr(level, r)')} AS r FROM l GROUP BY 1""")
def _(t):
    p = roles.yield_pairs(t).withColumn("residual", F.col("yield_sim") - F.col("yield"))
    return rounded(A.drivers(p, "residual", ["biomass", "tranrf"]))


@query("difference_medians_and_quartiles", "AGG-24", f"""
WITH f AS (SELECT 'price' AS feature, l_extendedprice / 2e3 AS s, l_quantity AS o FROM lineitem
           UNION ALL SELECT 'tax', l_tax, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END FROM lineitem)
SELECT feature, count(*) AS n, {rnd('quantile_cont(o, 0.5)')} AS obs_median, {rnd('quantile_cont(s, 0.5)')} AS sim_median,
       {rnd('quantile_cont(s - o, 0.5)')} AS median_diff, {rnd('quantile_cont(s - o, 0.25)')} AS diff_q25, {rnd('quantile_cont(s - o, 0.75)')} AS diff_q75
FROM f WHERE o IS NOT NULL AND s IS NOT NULL GROUP BY 1""")
def _(t):
    df = t.lineitem.select(
        "l_quantity", (F.col("l_extendedprice") / 2000.0).alias("s"), "l_tax",
        F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("d"),
    )
    return rounded(A.difference_summary(df, {"price": ("l_quantity", "s"), "tax": ("d", "l_tax")}))


_GRID = [i * 0.05 for i in range(41)]
_BANDS = "CAST(CASE WHEN dvs <= 0e0 THEN NULL " + " ".join(
    f"WHEN dvs <= CAST('{e!r}' AS DOUBLE) THEN {i}" for i, e in enumerate(_GRID[1:])) + " END AS INTEGER)"


@query("banded_trajectory", "AGG-25", f"""
WITH {CANOPY_SQL}
SELECT {_BANDS} AS band, {rnd('avg(dvs)')} AS dvs_mean, {rnd('quantile_cont(LAI, 0.25)')} AS "LAI_q25", {rnd('quantile_cont(LAI, 0.5)')} AS "LAI_median",
       {rnd('quantile_cont(LAI, 0.75)')} AS "LAI_q75", {rnd('quantile_cont(LAI_sim, 0.25)')} AS "LAI_sim_q25",
       {rnd('quantile_cont(LAI_sim, 0.5)')} AS "LAI_sim_median", {rnd('quantile_cont(LAI_sim, 0.75)')} AS "LAI_sim_q75"
FROM canopy WHERE {_BANDS} IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(A.banded_quartiles(stage(canopy(t), "pairs"), "dvs", _GRID, ["LAI", "LAI_sim"]))


@query("point_density_2d", "AGG-26", f"""
WITH {PHEN_SQL}, s AS (SELECT min(flowering_doy) AS x0, max(flowering_doy) AS x1, min(flowering_doy_sim) AS y0, max(flowering_doy_sim) AS y1 FROM phen),
c AS (SELECT PointID, greatest(0, least(59, floor((flowering_doy - x0) * 60e0 / (x1 - x0)))) AS ix,
             greatest(0, least(59, floor((flowering_doy_sim - y0) * 60e0 / (y1 - y0)))) AS iy FROM phen, s)
SELECT PointID, count(*) OVER (PARTITION BY ix, iy) AS density FROM c""")
def _(t):
    return A.density_2d(phen(t).select("PointID", "flowering_doy", "flowering_doy_sim"), "flowering_doy", "flowering_doy_sim").select(
        "PointID", "density"
    )


@query("shared_histogram", "AGG-27", f"""
WITH {PHEN_SQL}, s AS (SELECT least(min(flowering_doy), min(flowering_doy_sim)) AS lo, greatest(max(flowering_doy), max(flowering_doy_sim)) AS hi FROM phen),
l AS (SELECT 'flowering_doy' AS series, flowering_doy AS x FROM phen UNION ALL SELECT 'flowering_doy_sim', flowering_doy_sim FROM phen)
SELECT series, CAST(greatest(0, least(58, floor((x - lo) * 59e0 / (hi - lo)))) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY 1, 2""")
def _(t):
    return A.shared_histogram(phen(t), ["flowering_doy", "flowering_doy_sim"], 60)


@query("seasonal_mean_course", "AGG-28", f"""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(dayofyear(l_shipdate) AS INTEGER) AS doy, {rnd('avg(l_quantity)', 4)} AS l_quantity,
       {rnd('avg(l_extendedprice)', 4)} AS l_extendedprice FROM lineitem GROUP BY 1, 2""")
def _(t):
    df = t.lineitem.withColumn("year", F.year("l_shipdate"))
    out = A.seasonal_course(df, "l_shipdate", "year", ["l_quantity", "l_extendedprice"])
    return rounded(out, 4)


@query("annual_scenario_means", "AGG-29 PIP-21", f"""
SELECT c_mktsegment AS crop, o_orderpriority AS climate, o_orderstatus AS soil, CAST(year(o_orderdate) AS INTEGER) AS year,
       {rnd('avg(o_totalprice)', 4)} AS yield_mean, {rnd('avg(c_acctbal)', 4)} AS lai_mean, {rnd('avg(dayofyear(o_orderdate))', 4)} AS hdoy_mean,
       count(DISTINCT o_custkey) AS n_locations
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("crop"), F.col("o_orderpriority").alias("climate"), F.col("o_orderstatus").alias("soil"),
        F.year("o_orderdate").alias("year"), "o_totalprice", "c_acctbal", F.dayofyear("o_orderdate").alias("hdoy"), "o_custkey",
    )
    return rounded(A.annual_means(
        df, ["crop", "climate", "soil", "year"],
        {"yield_mean": "o_totalprice", "lai_mean": "c_acctbal", "hdoy_mean": "hdoy"}, "o_custkey",
    ), 4)


_SEASONS_SQL = """e AS (SELECT *, event_type = 'purchase' AS reset FROM events),
s AS (SELECT *, CAST(coalesce(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS season FROM e)"""


@query("season_rollup", "AGG-30", f"""
WITH {_SEASONS_SQL}
SELECT user_id, season, count(*) AS n_days, {rnd('sum(value)', 4)} AS rain, {rnd('avg(value)', 4)} AS tmean, {rnd('max(value)', 4)} AS top, {rnd('arg_max(value, (ts, event_id))', 4)} AS final
FROM s GROUP BY 1, 2 HAVING bool_or(reset)""")
def _(t):
    out = A.season_rollup(
        t.events.select("user_id", "ts", "event_id", "value", "event_type"), ["user_id"], ["ts", "event_id"],
        F.col("event_type") == "purchase",
        {"rain": ("SUM", "value"), "tmean": ("AVG", "value"), "top": ("MAX", "value"), "final": ("LAST", "value")},
    )
    return rounded(out, 4)


@query("season_ids_from_resets", "WIN-8", f"WITH {_SEASONS_SQL} SELECT event_id, user_id, season FROM s")
def _(t):
    df = t.events.select("event_id", "user_id", "ts", "event_type")
    return A.season_ids(df, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "season")


@query("layer_sums_and_means", "AGG-31 FN-A1", f"""
SELECT vec_id, {rnd('list_sum(list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)))')} AS top_sum,
       {rnd('list_sum(list_transform(embedding[10:15], lambda x: CAST(x AS DOUBLE)))')} AS mid_sum,
       {rnd('list_avg(list_transform(embedding[16:25], lambda x: CAST(x AS DOUBLE)))')} AS low_avg FROM embeddings""")
def _(t):
    layers = {"top_sum": (1, 10), "mid_sum": (10, 15), "low_avg": (16, 25, "avg")}
    return rounded(A.layer_slices(t.embeddings, ["vec_id"], "embedding", layers))


@query("coverage_and_drift", "AGG-34", """
SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last,
       CAST(abs(date_diff('day', DATE '1995-01-01', min(CAST(l_shipdate AS DATE)))) AS INTEGER) AS drift_days FROM lineitem GROUP BY 1""")
def _(t):
    df = t.lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"))
    return A.coverage(df, ["l_suppkey"], "d", F.make_date(F.lit(1995), F.lit(1), F.lit(1)))


@query("single_window_span", "AGG-33", """
WITH w AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
SELECT l_suppkey, count(*) AS n_rows, (SELECT max(n) FROM w) AS span, count(*) // (SELECT max(n) FROM w) AS n_windows
FROM lineitem WHERE (SELECT count(DISTINCT n) FROM w) = 1 GROUP BY 1""")
def _(t):
    # Windows must have one length: here the nations of a region, five in each.
    lengths = t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    span = R.assert_single_value(lengths, F.col("n"), "window span")
    rows = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("l_suppkey", "n_rows", F.lit(span).cast("long").alias("span"), F.floor(F.col("n_rows") / span).alias("n_windows"))


@query("run_summary_counters", "AGG-35", """
SELECT o_orderpriority AS exp_id, count(*) AS n_rows, count(DISTINCT o_custkey) AS points,
       CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("exp_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("points"),
        F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"),
    )


@query("temporal_decomposition", "AGG-36", f"""
WITH {PAIRS_SQL}
SELECT year, {rnd('avg(yield)')} AS obs, {rnd('avg(yield_sim)')} AS sim, count(*) AS n, {rnd('avg(yield_sim) - avg(yield)')} AS bias FROM pairs GROUP BY 1""")
def _(t):
    return rounded(A.temporal_decomposition(roles.yield_pairs(t), "year", "yield", "yield_sim"))


@query("temporal_summary", "AGG-36", f"""
WITH {PAIRS_SQL}, y AS (SELECT year, avg(yield) AS o, avg(yield_sim) AS s FROM pairs GROUP BY 1)
SELECT {rnd('sqrt(avg(pow(s - o, 2)))')} AS rmse_year_means, {rnd('regr_slope(s - o, year)')} AS trend_per_year FROM y""")
def _(t):
    y = A.temporal_decomposition(roles.yield_pairs(t), "year", "yield", "yield_sim")
    return rounded(A.temporal_summary(y, "year"))


@query("spatial_summary", "AGG-37", f"""
WITH {PAIRS_SQL}, s AS (SELECT avg(yield) AS o, avg(yield_sim) AS s FROM pairs GROUP BY STATE_NAME),
d AS (SELECT avg(yield_sim - yield) AS b FROM pairs GROUP BY NUTS_ID)
SELECT (SELECT {rnd('sqrt(avg(pow(s - o, 2)))')} FROM s) AS rmse_state_means, (SELECT {rnd('min(s - o)')} FROM s) AS state_bias_min,
       (SELECT {rnd('max(s - o)')} FROM s) AS state_bias_max, {rnd('quantile_cont(b, 0.25)')} AS district_bias_q25, {rnd('quantile_cont(b, 0.75)')} AS district_bias_q75 FROM d""")
def _(t):
    p = roles.staged_yield_pairs(t)
    states = A.temporal_decomposition(p, "STATE_NAME", "yield", "yield_sim")
    return rounded(A.spatial_summary(states, p, "NUTS_ID", "yield", "yield_sim"))


@query("compare_two_series", "AGG-38", f"""
WITH {PAIRS_SQL}, m AS (
SELECT count(*) AS n, sqrt(avg(pow(yield_sim - yield, 2))) AS a, sqrt(avg(pow(translocated - yield, 2))) AS b,
       quantile_cont(translocated - yield_sim, 0.5) AS q, avg(yield_sim) AS mp, avg(translocated) AS mo FROM pairs)
SELECT n, {rnd('a')} AS rmse_plain, {rnd('b')} AS rmse_other, {rnd('b - a')} AS rmse_delta, {rnd('q')} AS median_contribution,
       {rnd('mp')} AS mean_plain, {rnd('mo')} AS mean_other,
       CASE WHEN abs(b - a) < 5e-2 THEN 'indistinguishable' WHEN b < a THEN 'other fits better' ELSE 'other fits worse' END AS verdict FROM m WHERE n >= 5""")
def _(t):
    return rounded(A.compare_series(roles.staged_yield_pairs(t), "yield", "yield_sim", "translocated"))


@query("exact_quantiles_by_group", "AGG-24 AGG-25", f"""
SELECT l_suppkey, {rnd('quantile_cont(l_extendedprice, 0.25)', 4)} AS q25, {rnd('quantile_cont(l_extendedprice, 0.5)', 4)} AS q50,
       {rnd('quantile_cont(l_extendedprice, 0.75)', 4)} AS q75 FROM lineitem GROUP BY 1""")
def _(t):
    from ..operators.quantiles import exact_quantiles

    q = exact_quantiles(t.lineitem, ["l_suppkey"], {"p": "l_extendedprice"}, [0.25, 0.5, 0.75])
    return rounded(q.select("l_suppkey", *[F.col("p")[i].alias(f"q{n}") for i, n in enumerate((25, 50, 75))]), 4)


@query("join_of_points_and_district_means", "AGG-1 JN-3", f"""
WITH {POINTS_SQL}, {SIM_SQL}, d AS (SELECT NUTS_ID, avg(yield_sim) AS m FROM sim JOIN points USING (location) GROUP BY 1)
SELECT location, NUTS_ID, {rnd('m')} AS district_mean FROM points LEFT JOIN d USING (NUTS_ID)""")
def _(t):
    p = roles.points(t).select("location", "NUTS_ID")
    d = roles.sim_yearly(t).join(p, "location").groupBy("NUTS_ID").agg(F.avg("yield_sim").alias("district_mean"))
    return rounded(R.lookup(p, d, ["NUTS_ID"]))
