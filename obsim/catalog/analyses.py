"""Queries for the composite analyses a user calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import relational as R
from ..plans import diagnose as DG
from ..plans import views as V
from . import roles
from .aggregates import TWO_DIM_SQL, bin_sql, canopy, corr_sql, metric_sql, phen
from .registry import query, rnd, rounded
from .roles import CANOPY_SQL, DAILY_SQL, OBS_YIELD_SQL, PAIRS_SQL, PHEN_SQL, POINTS_SQL, SIM_SQL, STAGE_EDGES

SCALES = {"district-year": [], "nuts3-clim": ["NUTS_ID"], "state": ["STATE_NAME"], "yearly": ["year"]}

_SCALES_SQL = f"""a AS (SELECT 'district-year' AS scale, yield, yield_sim FROM pairs
 UNION ALL SELECT 'nuts3-clim', avg(yield), avg(yield_sim) FROM pairs GROUP BY NUTS_ID
 UNION ALL SELECT 'state', avg(yield), avg(yield_sim) FROM pairs GROUP BY STATE_NAME
 UNION ALL SELECT 'yearly', avg(yield), avg(yield_sim) FROM pairs GROUP BY year),
scales AS (SELECT scale, {corr_sql('yield', 'yield_sim')} FROM a GROUP BY 1)"""


@query("yield_comparison_four_scales", "PIP-10 SET-2 AGG-1 JN-1 AGG-13", f"WITH {PAIRS_SQL}, {_SCALES_SQL} SELECT * FROM scales")
def _(t):
    return rounded(M.multi_scale(roles.staged_yield_pairs(t), SCALES, "yield", "yield_sim"))


@query("correlation_pivot_by_scale", "SET-4 PIP-10", f"""
WITH {PAIRS_SQL}, {_SCALES_SQL}
SELECT 'all' AS crop, max(CASE WHEN scale = 'district-year' THEN r END) AS "district-year", max(CASE WHEN scale = 'nuts3-clim' THEN r END) AS "nuts3-clim",
       max(CASE WHEN scale = 'state' THEN r END) AS state, max(CASE WHEN scale = 'yearly' THEN r END) AS yearly FROM scales""")
def _(t):
    m = M.multi_scale(roles.staged_yield_pairs(t), SCALES, "yield", "yield_sim").withColumn("crop", F.lit("all"))
    return rounded(R.pivot_wide(m, ["crop"], "scale", "r", list(SCALES)))


@query("yield_view_pairs", "PIP-13 JN-16 AGG-1 PRJ-6", f"""
WITH {POINTS_SQL}, {SIM_SQL}, {OBS_YIELD_SQL},
d AS (SELECT NUTS_ID, STATE_NAME, year, avg(yield_sim) AS yield_sim, avg(biomass) AS biomass FROM sim JOIN points USING (location) GROUP BY 1, 2, 3)
SELECT NUTS_ID, STATE_NAME, year, {rnd('d.yield_sim')} AS yield_sim, {rnd('biomass')} AS biomass, {rnd('yield * 21e-2')} AS yield FROM d JOIN obs_yield USING (NUTS_ID, year)""")
def _(t):
    p = V.yield_view_pairs(roles.sim_yearly(t), roles.points(t), roles.obs_yield(t), ["yield_sim", "biomass"], 0.21)
    return rounded(p.drop("n_points"))


@query("phenology_comparison", "PIP-9 JN-1 FLT-9", f"""
WITH {PHEN_SQL}
SELECT PointID, harvest_year, STATE_NAME, flowering_doy, flowering_doy_sim, maturity_doy, maturity_doy_sim FROM phen""")
def _(t):
    return phen(t).select(
        "PointID", "harvest_year", "STATE_NAME", "flowering_doy", "flowering_doy_sim", "maturity_doy", "maturity_doy_sim"
    )


@query("anomaly_report_with_admin", "PIP-9 AGG-8 AGG-9 JN-3", f"""
WITH {PHEN_SQL}, {POINTS_SQL},
a AS (SELECT site, count(DISTINCT CASE WHEN abnormal THEN harvest_year END) AS n_abnormal_years, count(DISTINCT harvest_year) AS total_years FROM phen_all GROUP BY 1)
SELECT site, n_abnormal_years, total_years, round_even(n_abnormal_years / CAST(total_years AS DOUBLE), 3) AS abnormal_fraction, NUTS_ID, STATE_NAME, {rnd('lat', 4)} AS lat
FROM a LEFT JOIN (SELECT location AS site, NUTS_ID, STATE_NAME, lat FROM points) USING (site) WHERE n_abnormal_years > 0""")
def _(t):
    p = V.phenology_flagged(roles.sim_phenology(t), roles.obs_phenology(t))
    per = A.abnormal_summary(p, "abnormal", ["site"], "harvest_year").drop("first_abnormal_year", "last_abnormal_year")
    admin = roles.points(t).select(F.col("location").alias("site"), "NUTS_ID", "STATE_NAME", F.round(F.col("lat") + 1e-7, 4).alias("lat"))
    return R.lookup(per, admin, ["site"])


@query("phenology_trends_by_year", "AGG-4 PIP-9", f"""
WITH {PHEN_SQL}
SELECT harvest_year, {rnd('avg(flowering_doy)')} AS flowering_doy_mean, {rnd('stddev_samp(flowering_doy)')} AS flowering_doy_sd,
       {rnd('avg(maturity_doy_sim)')} AS maturity_doy_sim_mean, {rnd('stddev_samp(maturity_doy_sim)')} AS maturity_doy_sim_sd FROM phen GROUP BY 1""")
def _(t):
    return rounded(A.mean_and_sd(phen(t), ["harvest_year"], ["flowering_doy", "maturity_doy_sim"]))


@query("canopy_pairs", "PIP-12 JN-1 FLT-10 FLT-11", f"""
WITH {CANOPY_SQL} SELECT location, date, year, {rnd('dvs')} AS dvs, {rnd('LAI')} AS "LAI", {rnd('LAI_sim')} AS "LAI_sim" FROM canopy""")
def _(t):
    return rounded(canopy(t))


_CANOPY_LOSS = f"""b AS (SELECT {bin_sql('dvs')} AS sb, year, avg(LAI) AS o, avg(LAI_sim) AS s FROM canopy GROUP BY 1, 2),
g AS (SELECT sqrt(avg(pow(s - o, 2))) AS loss, avg(s - o) AS bias, count(*) AS n_groups FROM b WHERE sb IS NOT NULL),
r AS (SELECT sqrt(avg(pow(LAI_sim - LAI, 2))) AS d, count(*) AS n, count(DISTINCT location) AS l FROM canopy)"""


@query("canopy_view_score", "PIP-12 AGG-14", f"""
WITH {CANOPY_SQL}, {_CANOPY_LOSS}
SELECT {rnd('loss')} AS loss, {rnd('bias')} AS bias, n_groups, {rnd('d')} AS rmse_daily, n AS n_pairs, l AS locations FROM g, r""")
def _(t):
    return rounded(V.canopy_score(roles.daily_canopy(t), roles.obs_canopy(t), STAGE_EDGES))


@query("stage_evaluation", "PIP-17 AGG-18", f"""
WITH {PAIRS_SQL}, {PHEN_SQL}, {CANOPY_SQL}, {_CANOPY_LOSS}, {TWO_DIM_SQL},
l AS (SELECT 'phenology' AS component, (sqrt(avg(pow(flowering_doy_sim - flowering_doy, 2))) + sqrt(avg(pow(maturity_doy_sim - maturity_doy, 2)))) / 2 AS loss, 5e-1 AS weight, 6e0 AS scale FROM phen
  UNION ALL SELECT 'lai', loss, 5e-1, 15e-2 FROM g UNION ALL SELECT 'yield', (y.r + z.r) / 2, 5e-1, 5e-1 FROM y, z)
SELECT component, {rnd('loss')} AS loss, scale, weight, {rnd('loss / scale')} AS scaled, {rnd('weight * loss / scale')} AS contribution,
       {rnd('(SELECT sum(weight * loss / scale) / sum(weight) FROM l)')} AS objective, {rnd('weight * loss / scale / (SELECT sum(weight * loss / scale) FROM l)')} AS share FROM l""")
def _(t):
    comp = t.spark.createDataFrame(
        [("phenology", 0.5, 6.0), ("lai", 0.5, 0.15), ("yield", 0.5, 0.5)], "component string, weight double, scale double"
    )
    losses = {"phenology": V.phenology_loss(phen(t)), "lai": V.canopy_loss(canopy(t), STAGE_EDGES), "yield": V.yield_loss(roles.yield_pairs(t))}
    return rounded(V.evaluate_stage(losses, comp))


_STRUCT = f"""m AS (SELECT count(*) AS n_pairs, count(DISTINCT PointID) AS n_locations, min(harvest_year) AS first_year, max(harvest_year) AS last_year,
 quantile_cont(flowering_doy_sim - flowering_doy, 0.5) AS flowering_bias_median, quantile_cont(duration_sim - duration_obs, 0.5) AS duration_bias_median,
 quantile_cont(flowering_doy_sim - flowering_doy, 0.75) - quantile_cont(flowering_doy_sim - flowering_doy, 0.25) AS flowering_bias_iqr,
 quantile_cont(duration_sim - duration_obs, 0.75) - quantile_cont(duration_sim - duration_obs, 0.25) AS duration_bias_iqr,
 regr_slope(flowering_doy_sim - flowering_doy, flowering_doy) AS warmth_slope, regr_slope(flowering_doy_sim - flowering_doy, lat) AS latitude_slope,
 regr_slope(flowering_doy_sim - flowering_doy, harvest_year) AS year_slope FROM phen)"""


@query("phenology_residual_structure", "PIP-14 AGG-22", f"""
WITH {PHEN_SQL}, {_STRUCT}
SELECT n_pairs, n_locations, first_year, last_year, flowering_bias_median, duration_bias_median, flowering_bias_iqr, duration_bias_iqr,
       {rnd('warmth_slope')} AS warmth_slope, {rnd('latitude_slope')} AS latitude_slope, {rnd('year_slope')} AS year_slope FROM m""")
def _(t):
    return rounded(DG.phenology_structure(phen(t), "lat"))


@query("phenology_verdict", "PIP-14", f"""
WITH {PHEN_SQL}, {_STRUCT}, v AS (SELECT concat_ws('; ',
 CASE WHEN abs(flowering_bias_median) > 2 THEN concat('flowering ', printf('%.1f', abs(flowering_bias_median)), CASE WHEN flowering_bias_median > 0 THEN ' d late: lower TSUM1' ELSE ' d early: raise TSUM1' END, ', or TSUMEM/TBASEM when all years shift alike') END,
 CASE WHEN abs(duration_bias_median) > 2 THEN concat('duration ', printf('%.1f', abs(duration_bias_median)), CASE WHEN duration_bias_median > 0 THEN ' d long: lower TSUM2' ELSE ' d short: raise TSUM2' END) END,
 CASE WHEN abs(warmth_slope) > 25e-2 THEN concat('follows season warmth (', printf('%+.2f', warmth_slope), ' d/d): TEFFMX, TsumIncrementTableRate') END,
 CASE WHEN abs(latitude_slope) > 1 THEN concat('follows latitude (', printf('%+.2f', latitude_slope), ' d/deg): PhotoperiodTableFactor') END) AS p FROM m)
SELECT CASE WHEN p <> '' THEN p ELSE 'flowering and duration within tolerance: no change' END AS verdict FROM v""")
def _(t):
    s = DG.phenology_structure(phen(t), "lat")
    return s.select(DG.phenology_verdict(
        F.col("flowering_bias_median"), F.col("duration_bias_median"), F.col("warmth_slope"), F.col("latitude_slope")
    ).alias("verdict"))


@query("phenology_stage_metrics", "PIP-14 AGG-12", f"""
WITH {PHEN_SQL}, a AS (SELECT 'flowering' AS stage, flowering_doy AS o, flowering_doy_sim AS s FROM phen UNION ALL SELECT 'maturity', maturity_doy, maturity_doy_sim FROM phen
 UNION ALL SELECT 'duration', duration_obs, duration_sim FROM phen) SELECT stage, {metric_sql('o', 's')} FROM a GROUP BY 1""")
def _(t):
    pts = roles.obs_phenology(t).select("PointID", F.col("lat").alias("Latitude"))
    return rounded(DG.diagnose_phenology(phen(t), pts, blocks=["metrics"])["metrics"])


@query("canopy_season_overview", "PIP-15 AGG-24", f"""
WITH {CANOPY_SQL}, s AS (SELECT location, year, avg(LAI_sim - LAI) AS b, bool_and(LAI_sim > LAI) OR bool_and(LAI_sim < LAI) AS c FROM canopy GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT count(*) AS n_seasons, {rnd('100 * avg(CASE WHEN c THEN 1e0 ELSE 0e0 END)')} AS sign_consistent_pct, {rnd('quantile_cont(b, 0.25)')} AS bias_q25,
       {rnd('quantile_cont(b, 0.5)')} AS bias_median, {rnd('quantile_cont(b, 0.75)')} AS bias_q75 FROM s""")
def _(t):
    return rounded(DG.diagnose_canopy(canopy(t), STAGE_EDGES, blocks=["season_overview"])["season_overview"])


@query("canopy_worst_locations", "PIP-15 TOP-1", f"""
WITH {CANOPY_SQL}, p AS (SELECT location, avg(LAI_sim - LAI) AS b FROM canopy GROUP BY 1)
SELECT location, {rnd('b')} AS bias FROM p ORDER BY abs(b) DESC, location LIMIT 8""")
def _(t):
    return rounded(DG.diagnose_canopy(canopy(t), STAGE_EDGES, blocks=["worst_locations"])["worst_locations"])


_ATTR = """q AS (SELECT avg(yield_sim - yield) AS bias, quantile_cont(yield_sim / biomass, 0.5) AS hi, quantile_cont(yield / biomass, 0.5) AS hn,
 quantile_cont(biomass, 0.5) AS agb, quantile_cont(yield / (yield_sim / biomass), 0.5) AS an FROM pairs),
f AS (SELECT *, hi BETWEEN 35e-2 AND 55e-2 AS a, agb BETWEEN 8e0 AND 14e0 AS b, hn BETWEEN 35e-2 AND 55e-2 AS c, an BETWEEN 8e0 AND 14e0 AS d FROM q)"""


@query("yield_attribution", "PIP-16 PRJ-12 FN-C2", f"""
WITH {PAIRS_SQL}, {_ATTR}
SELECT {rnd('bias')} AS bias, {rnd('hi')} AS hi, {rnd('hn')} AS hi_needed, {rnd('agb')} AS agb, {rnd('an')} AS agb_needed, a AS hi_ok, b AS agb_ok, c AS hi_needed_ok, d AS agb_needed_ok,
 CASE WHEN abs(bias) < 25e-2 THEN 'bias is small' WHEN b AND NOT a THEN 'partitioning: harvest index implausible, biomass plausible'
  WHEN a AND NOT b THEN 'biomass: biomass implausible, harvest index plausible' WHEN c AND NOT d THEN 'prefer partitioning: only the index can close the gap'
  WHEN d AND NOT c THEN 'prefer biomass: only biomass can close the gap' ELSE 'both routes plausible: use drivers and structure' END AS verdict FROM f""")
def _(t):
    return rounded(DG.yield_attribution(roles.staged_yield_pairs(t), {"harvest_index": (0.35, 0.55), "biomass": (8.0, 14.0)}))


@query("yield_spatial_block", "PIP-16 AGG-37", f"""
WITH {PAIRS_SQL}
SELECT STATE_NAME, {rnd('avg(yield)')} AS obs, {rnd('avg(yield_sim)')} AS sim, count(*) AS n, {rnd('avg(yield_sim) - avg(yield)')} AS bias FROM pairs GROUP BY 1""")
def _(t):
    return rounded(DG.diagnose_yield(roles.yield_pairs(t), blocks=["by_state"])["by_state"])


@query("canopy_overall_agreement", "PIP-15 AGG-12", f"WITH {CANOPY_SQL} SELECT {metric_sql('LAI', 'LAI_sim')} FROM canopy")
def _(t):
    return rounded(DG.diagnose_canopy(canopy(t), STAGE_EDGES, blocks=["overall"])["overall"])


@query("yield_overall_agreement", "PIP-16 AGG-12", f"WITH {PAIRS_SQL} SELECT {metric_sql('yield', 'yield_sim')} FROM pairs")
def _(t):
    return rounded(DG.diagnose_yield(roles.yield_pairs(t), blocks=["overall"])["overall"])


@query("yield_bias_by_year", "PIP-16", f"""
WITH {PAIRS_SQL}
SELECT year, {rnd('avg(yield)')} AS obs, {rnd('avg(yield_sim)')} AS sim, count(*) AS n, {rnd('avg(yield_sim) - avg(yield)')} AS bias FROM pairs GROUP BY 1""")
def _(t):
    return rounded(DG.diagnose_yield(roles.yield_pairs(t), blocks=["by_year"])["by_year"])


@query("baseline_scenario_overview", "PIP-21 AGG-29 SRT-3", f"""
WITH a AS (SELECT c_mktsegment AS crop, o_orderstatus AS soil, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
SELECT crop, soil, year, {rnd('avg(o_totalprice)', 4)} AS yield_mean, count(DISTINCT o_custkey) AS n_locations FROM a GROUP BY 1, 2, 3""")
def _(t):
    df = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("crop"), F.col("o_orderstatus").alias("soil"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_custkey"
    )
    return rounded(A.annual_means(df, ["crop", "soil", "year"], {"yield_mean": "o_totalprice"}, "o_custkey"), 4)


@query("match_coverage_warning", "PIP-23", f"""
WITH {DAILY_SQL}, c AS (SELECT count(DISTINCT location) AS a FROM daily), m AS (SELECT count(DISTINCT location) AS b FROM daily JOIN obs_lai USING (location, date))
SELECT a AS n_simulated, b AS n_matched, CASE WHEN b < 5e-1 * a THEN 'few locations matched: another point set' ELSE 'ok' END AS note FROM c, m""")
def _(t):
    daily, obs = roles.daily_canopy(t), roles.obs_canopy(t)
    return DG.match_coverage(daily, R.pair(daily, obs, ["location", "date"]), "location")
