"""Queries for windows, series, season shapes and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import ledger as L
from ..operators import series as SR
from ..operators import shape as SH
from ..operators.aggregates import difference_summary
from ..operators.ordered import running
from ..session import stage
from . import roles
from .registry import query, rnd, rounded
from .roles import ANNUAL_SQL, LEDGER_SQL, MONTHLY_SQL, SEASON_SQL

BASE = (1996, 2000)
OVERLAP = (1998, 2000)
START = 1995
FIRST_OBSERVED = 1998 * 12 + 2  # months before March 1998 are reconstructed

# Months from March 1998 on play the observed record.
OBSERVED_SQL = f"{MONTHLY_SQL}, obs AS (SELECT * FROM monthly WHERE year * 12 + month - 1 >= {FIRST_OBSERVED})"

CENTRED_SQL = """centred AS (
  SELECT year, month, average,
         CASE WHEN count(average) OVER w = 12 THEN avg(average) OVER w END AS centred
  FROM {src} WINDOW w AS (ORDER BY year, month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))"""

CYCLE_SQL = """per AS (SELECT month, avg(average - centred) AS c FROM centred WHERE year BETWEEN {y0} AND {y1} GROUP BY 1),
cycle AS (SELECT month, c - (SELECT avg(c) FROM per) AS cycle FROM per)"""


def _cycle(src: str) -> str:
    return CENTRED_SQL.format(src=src) + ",\n" + CYCLE_SQL.format(y0=BASE[0], y1=BASE[1])


def observed(t):
    return roles.monthly(t).filter(F.col("year") * 12 + F.col("month") - 1 >= FIRST_OBSERVED)


def interp_sql(x: str, knots: str = "knots") -> str:
    """Scalar SQL: linear interpolation at x over a knot relation (x, y), ends held flat."""
    lo = f"(SELECT arg_max(y, k.x) FROM {knots} k WHERE k.x <= {x})"
    hi = f"(SELECT arg_min(y, k.x) FROM {knots} k WHERE k.x >= {x})"
    lx = f"(SELECT max(k.x) FROM {knots} k WHERE k.x <= {x})"
    hx = f"(SELECT min(k.x) FROM {knots} k WHERE k.x >= {x})"
    return (f"CASE WHEN {lx} IS NULL THEN {hi} WHEN {hx} IS NULL OR {hx} = {lx} THEN {lo} "
            f"ELSE {lo} + ({hi} - {lo}) / ({hx} - {lx}) * ({x} - {lx}) END")


@query("centred_yearly_mean", "WIN-1", f"""
WITH {MONTHLY_SQL}, {CENTRED_SQL.format(src='monthly')} SELECT year, month, {rnd('average', 5)} AS average, {rnd('centred', 5)} AS centred FROM centred""")
def _(t):
    return rounded(SR.centred_mean(roles.monthly(t), "average", ["year", "month"]), 5)


@query("seasonal_cycle", "WIN-16", f"""
WITH {MONTHLY_SQL}, {_cycle('monthly')} SELECT month, {rnd('cycle')} AS cycle FROM cycle""")
def _(t):
    return rounded(SR.seasonal_cycle(roles.monthly(t), *BASE))


@query("deseasonalised_series", "WIN-17 FN-D7", f"""
WITH {MONTHLY_SQL}, {_cycle('monthly')}
SELECT year, month, {rnd('year + (month - 5e-1) / 12e0')} AS x, {rnd('average - cycle')} AS value FROM monthly LEFT JOIN cycle USING (month)""")
def _(t):
    m = roles.monthly(t)
    return rounded(SR.deseasonalise(m, SR.seasonal_cycle(m, *BASE)))


@query("interpolate_on_annual_knots", "JN-15", f"""
WITH {ANNUAL_SQL}, knots AS (SELECT year + 5e-1 AS x, level AS y FROM annual),
d AS (SELECT o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 366e0 AS x FROM orders),
u AS (SELECT DISTINCT x FROM d), v AS (SELECT x, {interp_sql('u.x')} AS level FROM u)
SELECT o_orderkey, {rnd('level')} AS level FROM d JOIN v USING (x)""")
def _(t):
    knots = roles.annual(t).select((F.col("year") + 0.5).alias("kx"), F.col("level").alias("ky"))
    d = t.orders.select("o_orderkey", (F.year("o_orderdate") + (F.dayofyear("o_orderdate") - 1) / 366.0).alias("x"))
    return rounded(SR.interpolate(d, "x", knots, "kx", "ky", "level").select("o_orderkey", "level"))


@query("interpolate_on_clustered_knots", "JN-15", f"""
WITH knots AS (SELECT pow(p_partkey / 1e2, 3) AS x, p_retailprice AS y FROM part),
q AS (SELECT s_suppkey, pow(s_suppkey / 1e1, 3) AS x FROM supplier), v AS (SELECT s_suppkey, {interp_sql('q.x')} AS level FROM q)
SELECT s_suppkey, {rnd('level', 4)} AS level FROM v""")
def _(t):
    knots = t.part.select(F.pow(F.col("p_partkey") / 100.0, 3).alias("kx"), F.col("p_retailprice").alias("ky"))
    q = t.supplier.select("s_suppkey", F.pow(F.col("s_suppkey") / 10.0, 3).alias("x"))
    return rounded(SR.interpolate(q, "x", knots, "kx", "ky", "level").select("s_suppkey", "level"), 4)


SPLICE_SQL = f"""{OBSERVED_SQL}, {ANNUAL_SQL}, knots AS (SELECT year + 5e-1 AS x, level AS y FROM annual), {_cycle('obs')},
des AS (SELECT year + (month - 5e-1) / 12e0 AS x, average - cycle AS value FROM obs JOIN cycle USING (month)),
off AS (SELECT avg(value - at_x) AS o FROM (SELECT value, {interp_sql('des.x')} AS at_x FROM des WHERE x >= {OVERLAP[0]} AND x < {OVERLAP[1] + 1})),
need AS (SELECT m // 12 AS year, m % 12 + 1 AS month FROM range({START * 12}, {FIRST_OBSERVED}) r(m)),
needx AS (SELECT year, month, year + (month - 5e-1) / 12e0 AS x FROM need),
back AS (SELECT year, month, {interp_sql('needx.x')} + (SELECT o FROM off) + cycle AS average FROM needx JOIN cycle USING (month)),
spliced AS (
  SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, round_even(average, 2) AS average, true AS reconstructed FROM back
  UNION ALL SELECT year, month, average, false FROM obs)"""


@query("splice_back_to_start", "WIN-18 PIP-20", f"""
WITH {SPLICE_SQL} SELECT year, month, {rnd('average', 4)} AS average, reconstructed FROM spliced""")
def _(t):
    return rounded(SR.splice(observed(t), roles.annual(t), START, OVERLAP, BASE), 4)


@query("splice_offset", "WIN-18", f"WITH {SPLICE_SQL} SELECT {rnd('o')} AS \"offset\" FROM off")
def _(t):
    obs = observed(t)
    knots = roles.annual(t).select((F.col("year") + 0.5).alias("x"), F.col("level").alias("y"))
    return rounded(SR.splice_offset(obs, knots, OVERLAP, SR.seasonal_cycle(obs, *BASE)))


@query("series_integrity", "WIN-19", """
WITH m AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS n_months, count(*) FILTER (WHERE n > 1) AS n_duplicated, CAST(max(m) - min(m) + 1 - count(*) AS BIGINT) AS n_missing,
       CAST(min(m) // 12 AS INTEGER) AS first_year, CAST(max(m) // 12 AS INTEGER) AS last_year FROM m GROUP BY 1""")
def _(t):
    df = t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return SR.check_series(df, ["l_suppkey"])


@query("missing_months_in_series", "WIN-19 SET-3", """
WITH m AS (SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m FROM orders),
f AS (SELECT c, unnest(generate_series(min(m), max(m))) AS m FROM m GROUP BY 1)
SELECT c, CAST(m // 12 AS INTEGER) AS year, CAST(m % 12 + 1 AS INTEGER) AS month FROM (SELECT c, m FROM f EXCEPT SELECT c, m FROM m)""")
def _(t):
    df = t.orders.select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return SR.missing_months(df, ["c"])


@query("unsorted_series_rows", "WIN-19", """
WITH m AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders),
w AS (SELECT *, max(year * 12 + month) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m)
SELECT o_custkey, o_orderkey, year, month FROM w WHERE year * 12 + month < top""")
def _(t):
    df = t.orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return SR.unsorted_rows(df, "o_orderkey", ["o_custkey"])


@query("series_covers_period", "WIN-19", """
SELECT o_custkey, min(year(o_orderdate)) <= 1995 AND max(year(o_orderdate)) >= 2001 AS covers FROM orders GROUP BY 1""")
def _(t):
    df = t.orders.select("o_custkey", F.year("o_orderdate").alias("year"))
    return SR.covers(df, 1995, 2001, ["o_custkey"])


# -------------------------------------------------------------- season shapes

WRAP_SQL = f"""{SEASON_SQL},
wrap AS (SELECT *, dayofyear(date) AS doy, dayofyear(date) < lag(dayofyear(date)) OVER w AS dec,
                row_number() OVER w AS pos FROM season WINDOW w AS (PARTITION BY location, year ORDER BY date)),
turn AS (SELECT location, year, min(pos) FILTER (WHERE dec) AS tp FROM wrap GROUP BY 1, 2),
days AS (SELECT w.*, CAST(doy + CASE WHEN pos >= tp THEN 365 ELSE 0 END AS DOUBLE) AS day FROM wrap w JOIN turn USING (location, year))"""


@query("unrolled_day_axis", "WIN-9", f"WITH {WRAP_SQL} SELECT location, year, date, day FROM days")
def _(t):
    return SH.unrolled_day(roles.season_pairs(t), ["location", "year"], "date").select("location", "year", "date", "day")


PEAKS_SQL = f"""{WRAP_SQL},
top AS (SELECT location, year, count(*) AS n, arg_max(date, (LAI, -epoch(date))) AS od, max(LAI) AS op,
               arg_max(date, (LAI_sim, -epoch(date))) AS sd, max(LAI_sim) AS sp,
               arg_max(dvs, (LAI, -epoch(date))) AS og, arg_max(dvs, (LAI_sim, -epoch(date))) AS sg FROM days GROUP BY 1, 2)"""


@query("season_peaks", "WIN-10", f"""
WITH {PEAKS_SQL}
SELECT location, year, n, {rnd('op')} AS "LAI_peak", od AS "LAI_peak_date", CAST(dayofyear(od) AS INTEGER) AS "LAI_peak_doy", {rnd('og')} AS "LAI_peak_stage",
       {rnd('sp')} AS "LAI_sim_peak", sd AS "LAI_sim_peak_date", CAST(dayofyear(sd) AS INTEGER) AS "LAI_sim_peak_doy", {rnd('sg')} AS "LAI_sim_peak_stage" FROM top""")
def _(t):
    return rounded(SH.season_peaks(roles.season_pairs(t), ["location", "year"], "date", "dvs", ["LAI", "LAI_sim"]))


def _slope(y: str, cond: str) -> str:
    x = f"CASE WHEN {cond} THEN day END"
    return (f"CASE WHEN count({x}) >= 3 AND max({x}) > min({x}) THEN "
            f"{rnd(f'regr_slope(CASE WHEN {cond} THEN {y} END, {x})')} END")


def _plateau(y: str, p: str) -> str:
    x = f"CASE WHEN {y} >= 8e-1 * {p} THEN day END"
    return f"CASE WHEN count({x}) >= 2 THEN {rnd(f'max({x}) - min({x})')} ELSE {rnd('0e0')} END"


SHAPE_SQL = f"""{PEAKS_SQL},
shape AS (
  SELECT location, year, n, {rnd('op')} AS obs_peak, {rnd('sp')} AS sim_peak, CAST(dayofyear(od) AS INTEGER) AS obs_peak_doy,
         CAST(dayofyear(sd) AS INTEGER) AS sim_peak_doy, {rnd('og')} AS obs_peak_stage, {rnd('sg')} AS sim_peak_stage,
         {rnd('avg(CASE WHEN dvs <= 3e-1 THEN LAI END)')} AS obs_early, {rnd('avg(CASE WHEN dvs <= 3e-1 THEN LAI_sim END)')} AS sim_early,
         {_slope('LAI', 'dvs BETWEEN 2e-1 AND 1e0')} AS obs_rise, {_slope('LAI_sim', 'dvs BETWEEN 2e-1 AND 1e0')} AS sim_rise,
         {_slope('LAI', 'date > od')} AS obs_decline, {_slope('LAI_sim', 'date > sd')} AS sim_decline,
         {_plateau('LAI', 'op')} AS obs_plateau_days, {_plateau('LAI_sim', 'sp')} AS sim_plateau_days,
         {rnd('avg(LAI_sim - LAI)')} AS bias, bool_and(LAI_sim > LAI) OR bool_and(LAI_sim < LAI) AS sign_consistent
  FROM days JOIN top USING (location, year) WHERE n >= 5 GROUP BY location, year, n, op, sp, od, sd, og, sg)"""


@query("season_shape_table", "WIN-11 WIN-12 WIN-13 WIN-14 WIN-15", f"WITH {SHAPE_SQL} SELECT * FROM shape")
def _(t):
    return rounded(SH.season_shape(roles.season_pairs(t), ["location", "year"], "date", "dvs", "LAI", "LAI_sim"))


@query("season_shape_summary", "AGG-24 PIP-15", f"""
WITH {SHAPE_SQL}, f AS (
  SELECT 'peak' AS feature, obs_peak AS o, sim_peak AS s FROM shape UNION ALL SELECT 'peak_doy', obs_peak_doy, sim_peak_doy FROM shape
  UNION ALL SELECT 'early', obs_early, sim_early FROM shape UNION ALL SELECT 'rise', obs_rise, sim_rise FROM shape
  UNION ALL SELECT 'decline', obs_decline, sim_decline FROM shape UNION ALL SELECT 'plateau', obs_plateau_days, sim_plateau_days FROM shape)
SELECT feature, count(*) AS n, {rnd('quantile_cont(o, 0.5)', 4)} AS obs_median, {rnd('quantile_cont(s, 0.5)', 4)} AS sim_median,
       {rnd('quantile_cont(s - o, 0.5)', 4)} AS median_diff, {rnd('quantile_cont(s - o, 0.25)', 4)} AS diff_q25, {rnd('quantile_cont(s - o, 0.75)', 4)} AS diff_q75
FROM f WHERE o IS NOT NULL AND s IS NOT NULL GROUP BY 1""")
def _(t):
    shape = stage(SH.season_shape(roles.season_pairs(t), ["location", "year"], "date", "dvs", "LAI", "LAI_sim"), "seasons")
    return rounded(difference_summary(shape, {
        "peak": ("obs_peak", "sim_peak"), "peak_doy": ("obs_peak_doy", "sim_peak_doy"), "early": ("obs_early", "sim_early"),
        "rise": ("obs_rise", "sim_rise"), "decline": ("obs_decline", "sim_decline"),
        "plateau": ("obs_plateau_days", "sim_plateau_days"),
    }), 4)


# --------------------------------------------------------------------- ledger

BEST_SQL = f"""{LEDGER_SQL},
b AS (SELECT *, min(objective) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ledger)"""


@query("running_best_objective", "WIN-4 WIN-5", f"""
WITH {BEST_SQL}
SELECT iteration, status, objective, prev AS previous_best, least(prev, objective) AS best_so_far,
       CASE WHEN status = 'completed' THEN prev IS NULL OR objective < prev - 5e-1 END AS improved,
       CASE WHEN status = 'completed' THEN prev IS NULL OR objective < prev END AS is_best,
       CASE WHEN status = 'completed' THEN prev IS NULL OR objective < prev END AS accepted,
       {rnd('objective - prev')} AS delta_vs_best FROM b""")
def _(t):
    df = roles.ledger(t).select("iteration", "status", "objective")
    return rounded(L.running_best(df, min_improvement=0.5, digits=9))


@query("running_best_per_crop", "WIN-4 WIN-5", f"""
WITH {LEDGER_SQL}
SELECT crop, iteration, min(objective) OVER (PARTITION BY crop ORDER BY iteration) AS best_so_far FROM ledger""")
def _(t):
    df = roles.ledger(t).select("crop", "iteration", "objective")
    return running(df, ["crop"], ["iteration"], {"best_so_far": ("min", "objective")}).drop("objective")


STOP_SQL = f"""{LEDGER_SQL}, d AS (SELECT * FROM ledger WHERE status = 'completed'),
g AS (SELECT crop, count(*) AS n, min(objective) AS o FROM d GROUP BY 1),
i AS (SELECT crop, n, o, min(iteration) AS it FROM d JOIN g USING (crop) WHERE objective = o GROUP BY 1, 2, 3),
s AS (SELECT i.crop, n, o, it, count(*) FILTER (WHERE d.iteration > it) AS since FROM i JOIN d USING (crop) GROUP BY 1, 2, 3, 4)"""


@query("iterations_since_best_and_stop", "WIN-6", f"""
WITH {STOP_SQL}, r AS (SELECT *, concat_ws('; ', CASE WHEN n >= 60 THEN 'iteration limit reached' END, CASE WHEN o <= 25e-2 THEN 'target reached' END,
        CASE WHEN since >= 30 THEN 'patience exhausted' END) AS why FROM s)
SELECT crop, n AS n_completed, o AS best_objective, it AS best_iteration, since AS since_improvement, why <> '' AS stop,
       CASE WHEN why <> '' THEN why ELSE 'criteria not met' END AS reason FROM r""")
def _(t):
    return L.stop_status(roles.ledger(t), by=["crop"], max_iterations=60, target=0.25, patience=30)


@query("next_iteration_id", "WIN-7", f"""
WITH {LEDGER_SQL} SELECT crop, coalesce(max(iteration), -1) + 1 AS next_id FROM ledger GROUP BY 1""")
def _(t):
    return L.next_id(roles.ledger(t), by=["crop"])


@query("best_record_per_crop", "TOP-4", f"""
WITH {STOP_SQL} SELECT crop, it AS iteration, 'completed' AS status, o AS objective FROM i""")
def _(t):
    return L.best_record(roles.ledger(t).select("crop", "iteration", "status", "objective"), by=["crop"])


@query("ledger_history", "PIP-18 WIN-4", f"""
WITH {BEST_SQL}
SELECT iteration, CASE WHEN status = 'completed' THEN printf('%.4f', objective) ELSE 'FAILED' END AS objective_text,
       {rnd('objective - prev', 4)} AS delta_vs_best, CASE WHEN status = 'completed' AND (prev IS NULL OR objective < prev) THEN '+' ELSE ' ' END AS mark,
       CASE WHEN iteration % 4 = 0 THEN 'baseline' WHEN iteration % 4 = 1 THEN 'k' ELSE 'a, k' END AS changed,
       coalesce(CASE WHEN status = 'completed' THEN prev IS NULL OR objective < prev END, false) AS is_best, {rnd('least(prev, objective)', 4)} AS best_so_far FROM b""")
def _(t):
    k = F.col("iteration") % 4
    names = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("k"))).otherwise(F.array(F.lit("k"), F.lit("a")))
    df = roles.ledger(t).withColumn("parameters_changed", F.map_from_arrays(names, names))
    out = L.history(df, digits=9)
    return rounded(out, 4)


@query("duration_texts", "FN-D8", """
WITH d AS (SELECT event_id, event_id % 7 AS d, event_id % 24 AS h, event_id % 60 AS m, event_id % 59 AS s FROM events)
SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN d * 86400 + h * 3600 + m * 60 + s WHEN 1 THEN d * 86400 + h * 3600 + m * 60
   WHEN 2 THEN d * 86400 + h * 3600 WHEN 3 THEN h * 3600 + m * 60 + s WHEN 4 THEN m * 60 + s ELSE m * 60 END AS INTEGER) AS seconds FROM d""")
def _(t):
    e = F.col("event_id")

    def part(n):
        return (e % n).cast("string")

    d, h, m, s = part(7), part(24), part(60), part(59)
    c, dash = F.lit(":"), F.lit("-")
    text = (
        F.when(e % 6 == 0, F.concat(d, dash, h, c, m, c, s)).when(e % 6 == 1, F.concat(d, dash, h, c, m))
        .when(e % 6 == 2, F.concat(d, dash, h)).when(e % 6 == 3, F.concat(h, c, m, c, s))
        .when(e % 6 == 4, F.concat(m, c, s)).otherwise(m)
    )
    return t.events.select("event_id", D.duration_seconds(text).alias("seconds"))
