"""Grouped aggregates: districts, climatologies, bias tables, densities, seasons, layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import slice_avg, slice_sum
from ..functions.numeric import (
    as_col, edge_bin, equal_bin, half_open_edge_bin, histogram_bin, ols_slope, safe_corr, whole_days,
)
from ..session import stage
from .metrics import bias, rmse
from .ordered import running
from .quantiles import exact_quantiles
from .relational import to_long


def district_year(df: DataFrame, keys: Sequence[str], values: Sequence[str], point: str) -> DataFrame:
    """Mean of every value column and distinct contributing points per district-year."""
    return df.groupBy(*keys).agg(
        *[F.avg(v).alias(v) for v in values], F.count_distinct(point).alias("n_points")
    )


def climatology(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Multi-year mean per place."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def mean_and_sd(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each column per group."""
    exprs = []
    for v in values:
        exprs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return df.groupBy(*by).agg(*exprs)


def small_domain_median(c: Column | str) -> Column:
    """Exact median of whole days; other values are an error (see ``whole_days``)."""
    return F.percentile(whole_days(c), F.lit(0.5))


def group_median_or_global(df: DataFrame, by: Sequence[str], value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Half-even rounded medians per group, and the one-row global median."""
    per = df.groupBy(*by).agg(F.bround(small_domain_median(value), 0).cast("int").alias(name))
    overall = df.agg(F.bround(small_domain_median(value), 0).cast("int").alias("global_value"))
    return per, overall


def station_medians(df: DataFrame, keys: Sequence[str], doys: Sequence[str]) -> DataFrame:
    """Rounded median day of each event per station."""
    return df.groupBy(*keys).agg(
        *[F.bround(small_domain_median(d), 0).cast("int").alias(d) for d in doys]
    )


def abnormal_summary(df: DataFrame, flag: str, keys: Sequence[str], year: str) -> DataFrame:
    """Affected years per key: count, first, last, total years and affected fraction."""
    hit = F.when(F.col(flag), F.col(year))
    out = df.groupBy(*keys).agg(
        F.count_distinct(hit).alias("n_abnormal_years"),
        F.min(hit).alias("first_abnormal_year"),
        F.max(hit).alias("last_abnormal_year"),
        F.count_distinct(year).alias("total_years"),
    )
    share = F.bround(F.col("n_abnormal_years") / F.col("total_years"), 3)
    return out.filter(F.col("n_abnormal_years") > 0).withColumn("abnormal_fraction", share)


def bias_table(df: DataFrame, by: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Count and median residual (sim - obs) per group for whole-day columns."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[small_domain_median(F.col(s) - F.col(o)).alias(f"{name}_bias") for name, (o, s) in pairs.items()],
    )


def stage_bin_table(df: DataFrame, stage: str, edges: Sequence[float], obs: str, sim: str) -> DataFrame:
    """n, means, bias, RMSE and relative bias per stage bin."""
    return (
        df.withColumn("stage_bin", edge_bin(stage, edges))
        .filter(F.col("stage_bin").isNotNull())
        .groupBy("stage_bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(obs).alias("obs_mean"),
            F.avg(sim).alias("sim_mean"),
            bias(obs, sim).alias("bias"),
            rmse(obs, sim).alias("rmse"),
        )
        .withColumn("rel_bias_pct", F.try_divide(100 * F.col("bias"), F.col("obs_mean")))
    )


def residual_overview(df: DataFrame, obs: str, sim: str, stage: str) -> DataFrame:
    """Mean, sample SD and the slopes of the residual against stage and observation."""
    r = F.col(sim) - F.col(obs)
    return df.agg(
        F.avg(r).alias("mean_residual"),
        F.stddev_samp(r).alias("residual_sd"),
        ols_slope(r, stage).alias("vs_stage_slope"),
        ols_slope(r, obs).alias("vs_obs_slope"),
    )


def residual_by_month(df: DataFrame, date: str, obs: str, sim: str) -> DataFrame:
    r = F.col(sim) - F.col(obs)
    return df.groupBy(F.month(date).alias("month")).agg(F.avg(r).alias("mean"), F.count(r).alias("n"))


def place_bias(df: DataFrame, place: str, obs: str, sim: str) -> DataFrame:
    return df.groupBy(place).agg(bias(obs, sim).alias("bias"))


def place_bias_spread(df: DataFrame, place: str, obs: str, sim: str) -> DataFrame:
    """Quartiles of per-place mean bias and the share of places biased high."""
    per = stage(place_bias(df, place, obs, sim), "places")  # one row per place, read twice
    q = exact_quantiles(per, [], {"bias": "bias"}, [0.25, 0.75])
    high = per.agg((100 * F.avg((F.col("bias") > 0).cast("double"))).alias("biased_high_pct"))
    return q.crossJoin(high).select(
        F.col("bias")[0].alias("bias_q25"), F.col("bias")[1].alias("bias_q75"), "biased_high_pct"
    )


def drivers(df: DataFrame, residual: str, columns: Sequence[str]) -> DataFrame:
    """Pearson r of a residual with each driver; needs more than 3 pairs and variation."""
    long = to_long(df, [residual], columns, "driver", "level").filter(
        F.col("level").isNotNull() & F.col(residual).isNotNull()
    )
    return (
        long.groupBy("driver")
        .agg(F.count(F.lit(1)).alias("n"), safe_corr("level", residual).alias("r"))
        .filter((F.col("n") > 3) & F.col("r").isNotNull())
    )


def difference_summary(df: DataFrame, features: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Medians, median difference and its quartiles per feature over complete pairs."""
    spec = {}
    for name, (o, s) in features.items():
        both = F.col(o).isNotNull() & F.col(s).isNotNull()
        spec[f"{name}|obs"] = F.when(both, F.col(o))
        spec[f"{name}|sim"] = F.when(both, F.col(s))
        spec[f"{name}|diff"] = F.when(both, F.col(s) - F.col(o))
    q = exact_quantiles(df, [], spec, [0.25, 0.5, 0.75])
    n = df.agg(*[
        F.count_if(F.col(o).isNotNull() & F.col(s).isNotNull()).alias(f"{name}|n")
        for name, (o, s) in features.items()
    ])
    wide = q.crossJoin(n)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("feature"),
            F.col(f"`{name}|n`").alias("n"),
            F.col(f"`{name}|obs`")[1].alias("obs_median"),
            F.col(f"`{name}|sim`")[1].alias("sim_median"),
            F.col(f"`{name}|diff`")[1].alias("median_diff"),
            F.col(f"`{name}|diff`")[0].alias("diff_q25"),
            F.col(f"`{name}|diff`")[2].alias("diff_q75"),
        )
        for name in features
    ])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def banded_quartiles(
    df: DataFrame, x: str, edges: Sequence[float], values: Sequence[str]
) -> DataFrame:
    """Mean x, medians and quartiles of each value on right-closed bands; incomplete bands drop."""
    banded = df.withColumn("band", half_open_edge_bin(x, edges)).filter(F.col("band").isNotNull())
    centre = banded.groupBy("band").agg(F.avg(x).alias(f"{x}_mean"))
    q = exact_quantiles(banded, ["band"], {v: v for v in values}, [0.25, 0.5, 0.75])
    cols = []
    for v in values:
        cols += [
            F.col(v)[0].alias(f"{v}_q25"), F.col(v)[1].alias(f"{v}_median"), F.col(v)[2].alias(f"{v}_q75"),
        ]
    return centre.join(q, "band").select("band", f"{x}_mean", *cols).dropna()


def value_span(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the minimum and maximum of each column."""
    exprs = []
    for c in columns:
        exprs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    return df.agg(*exprs)


def density_2d(df: DataFrame, x: str, y: str, bins: int = 60, name: str = "density") -> DataFrame:
    """Number of points in each point's cell of an equal bins x bins grid."""
    span = value_span(df, [x, y])
    celled = df.crossJoin(F.broadcast(span)).select(
        *df.columns,
        histogram_bin(x, F.col(f"_lo_{x}"), F.col(f"_hi_{x}"), bins).alias("_ix"),
        histogram_bin(y, F.col(f"_lo_{y}"), F.col(f"_hi_{y}"), bins).alias("_iy"),
    )
    # At most bins * bins rows, so the broadcast has a fixed bound.
    cells = celled.groupBy("_ix", "_iy").agg(F.count(F.lit(1)).alias(name))
    return celled.join(F.broadcast(cells), ["_ix", "_iy"]).drop("_ix", "_iy")


def shared_histogram(df: DataFrame, columns: Sequence[str], edges: int) -> DataFrame:
    """Counts of several columns on shared equal bins given by a number of edges."""
    bins = edges - 1
    span = df.agg(
        F.least(*[F.min(c) for c in columns]).alias("_lo"), F.greatest(*[F.max(c) for c in columns]).alias("_hi")
    )
    return (
        to_long(df, [], columns, "series", "x")
        .filter(F.col("x").isNotNull())
        .crossJoin(F.broadcast(span))
        .withColumn("bin", histogram_bin("x", F.col("_lo"), F.col("_hi"), bins))
        .groupBy("series", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def seasonal_course(df: DataFrame, date: str, year: str, values: Sequence[str]) -> DataFrame:
    """Mean course by year and day of year."""
    return df.groupBy(year, F.dayofyear(date).alias("doy")).agg(*[F.avg(v).alias(v) for v in values])


def annual_means(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], point: str) -> DataFrame:
    """Annual means per scenario with the number of locations behind them."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(name) for name, c in values.items()],
        F.count_distinct(point).alias("n_locations"),
    )


def season_rollup(
    df: DataFrame, key: Sequence[str], order: Sequence[str], reset: Column, modes: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Daily rows to one row per season: SUM, AVG, MAX or LAST per column.

    A season ends with its reset row; rows after the last reset form an
    unfinished season and are not reported.
    """
    marked = season_ids(df, key, order, reset)
    fns = {"SUM": F.sum, "AVG": F.avg, "MAX": F.max}
    last = F.struct(*[F.col(o) for o in order])
    exprs = [
        (F.max_by(F.col(c), last) if mode == "LAST" else fns[mode](c)).alias(name)
        for name, (mode, c) in modes.items()
    ]
    return (
        marked.withColumn("_reset", F.coalesce(reset, F.lit(False)))
        .groupBy(*key, "season")
        .agg(F.max("_reset").alias("_done"), F.count(F.lit(1)).alias("n_days"), *exprs)
        .filter("_done").drop("_done")
    )


def season_ids(
    df: DataFrame, key: Sequence[str], order: Sequence[str], reset: Column, name: str = "season"
) -> DataFrame:
    """0-based season number: resets strictly before the row."""
    flag = F.when(reset, F.lit(1)).otherwise(F.lit(0))
    out = running(df, key, order, {name: ("sum", flag)}, inclusive=False)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def layer_slices(df: DataFrame, keep: Sequence[str], arr: str, slices: Mapping[str, tuple[int, int] | tuple[int, int, str]], how: str = "sum") -> DataFrame:
    """Sums and means of 1-based inclusive layer ranges of an array column, in one projection; ``how`` where a range names none."""
    fn = {"sum": slice_sum, "avg": slice_avg}
    return df.select(*keep, *[fn[s[2] if len(s) > 2 else how](arr, s[0], s[1]).alias(name) for name, s in slices.items()])


def message_kinds(df: DataFrame, by: Sequence[str], kind: str = "kind") -> DataFrame:
    """Tally of message kinds, most frequent first within each group."""
    out = df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(*by, F.col("n").desc(), kind)


def coverage(df: DataFrame, by: Sequence[str], date: str, nominal_start: Column | None = None) -> DataFrame:
    """First and last date per source, and days between nominal and actual start."""
    out = df.groupBy(*by).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    if nominal_start is None:
        return out
    return out.withColumn("drift_days", F.abs(F.datediff(F.col("first"), nominal_start)))


def temporal_decomposition(df: DataFrame, year: str, obs: str, sim: str) -> DataFrame:
    """Observed and simulated year means with their bias."""
    return df.groupBy(year).agg(
        F.avg(obs).alias("obs"), F.avg(sim).alias("sim"), F.count(F.lit(1)).alias("n")
    ).withColumn("bias", F.col("sim") - F.col("obs"))


def temporal_summary(by_year: DataFrame, year: str) -> DataFrame:
    return by_year.agg(
        rmse("obs", "sim").alias("rmse_year_means"), ols_slope("bias", year).alias("trend_per_year")
    )


def spatial_summary(by_state: DataFrame, df: DataFrame, district: str, obs: str, sim: str) -> DataFrame:
    """RMSE of state means, range of state bias, quartiles of district bias."""
    states = by_state.agg(
        rmse("obs", "sim").alias("rmse_state_means"),
        F.min("bias").alias("state_bias_min"),
        F.max("bias").alias("state_bias_max"),
    )
    q = exact_quantiles(place_bias(df, district, obs, sim), [], {"q": "bias"}, [0.25, 0.75])
    return states.crossJoin(q).select(
        "rmse_state_means", "state_bias_min", "state_bias_max",
        F.col("q")[0].alias("district_bias_q25"), F.col("q")[1].alias("district_bias_q75"),
    )


def compare_series(df: DataFrame, obs: str, plain: str, other: str, band: float = 0.05, need: int = 5) -> DataFrame:
    """Score two candidate series on the same complete rows and say which fits better."""
    ok = df.filter(F.col(obs).isNotNull() & F.col(plain).isNotNull() & F.col(other).isNotNull())
    sums = ok.agg(
        F.count(F.lit(1)).alias("n"),
        rmse(obs, plain).alias("rmse_plain"),
        rmse(obs, other).alias("rmse_other"),
        F.avg(plain).alias("mean_plain"),
        F.avg(other).alias("mean_other"),
    )
    q = exact_quantiles(ok, [], {"gain": F.col(other) - F.col(plain)}, [0.5])
    delta = F.col("rmse_other") - F.col("rmse_plain")
    return (
        sums.crossJoin(q)
        .filter(F.col("n") >= need)
        .select(
            "n", "rmse_plain", "rmse_other", delta.alias("rmse_delta"),
            F.col("gain")[0].alias("median_contribution"), "mean_plain", "mean_other",
            F.when(F.abs(delta) < band, "indistinguishable")
            .when(delta < 0, "other fits better")
            .otherwise("other fits worse").alias("verdict"),
        )
    )


def latitude_bands(df: DataFrame, lat: str, residual: str, n: int = 4) -> DataFrame:
    """Median whole-day residual on equal latitude bands."""
    span = value_span(df, [lat])
    return (
        df.crossJoin(F.broadcast(span))
        .withColumn("band", equal_bin(lat, F.col(f"_lo_{lat}"), F.col(f"_hi_{lat}"), n))
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("n"), small_domain_median(residual).alias("bias"))
    )
