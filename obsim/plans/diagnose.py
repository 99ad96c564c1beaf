"""Diagnostics of phenology, canopy and yield errors; each returns a dict of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import in_range, ols_slope, whole_days
from ..operators import aggregates as A
from ..operators.metrics import agreement
from ..operators.quantiles import exact_quantiles
from ..operators.relational import top_abs, union_tagged
from ..operators.shape import season_shape
from ..session import stage

# Thresholds of the verdicts (fixed values).
TOLERANCE_DAYS = 2.0
WARMTH_SLOPE = 0.25
LATITUDE_SLOPE = 1.0
LATITUDE_BANDS = 4
MIN_LATITUDE_PAIRS = 10
SMALL_YIELD_BIAS = 0.25
WORST_PLACES = 8
WORST_YEARS = 6

STAGES = {
    "flowering": ("flowering_doy", "flowering_doy_sim"),
    "maturity": ("maturity_doy", "maturity_doy_sim"),
    "duration": ("duration_obs", "duration_sim"),
}


def phenology_verdict(flowering: Column, duration: Column, warmth: Column, latitude: Column) -> Column:
    """The parameters the residual structure points at, in one sentence."""
    def days(c: Column) -> Column:
        return F.format_string("%.1f", F.abs(c))

    late = F.concat(
        F.lit("flowering "), days(flowering), F.when(flowering > 0, " d late: lower TSUM1").otherwise(" d early: raise TSUM1"),
        F.lit(", or TSUMEM/TBASEM when all years shift alike"),
    )
    long = F.concat(
        F.lit("duration "), days(duration), F.when(duration > 0, " d long: lower TSUM2").otherwise(" d short: raise TSUM2")
    )
    parts = F.concat_ws(
        "; ",
        F.when(F.abs(flowering) > TOLERANCE_DAYS, late),
        F.when(F.abs(duration) > TOLERANCE_DAYS, long),
        F.when(
            F.abs(warmth) > WARMTH_SLOPE,
            F.concat(F.lit("follows season warmth ("), F.format_string("%+.2f", warmth), F.lit(" d/d): TEFFMX, TsumIncrementTableRate")),
        ),
        F.when(
            F.abs(latitude) > LATITUDE_SLOPE,
            F.concat(F.lit("follows latitude ("), F.format_string("%+.2f", latitude), F.lit(" d/deg): PhotoperiodTableFactor")),
        ),
    )
    return F.when(parts != "", parts).otherwise("flowering and duration within tolerance: no change")


def phenology_structure(df: DataFrame, latitude: str | None = None) -> DataFrame:
    """One row: counts, residual medians, quartile ranges and slopes.

    Residuals are whole days, so the quantiles come from small value counts.
    """
    f = F.col("flowering_doy_sim") - F.col("flowering_doy")
    d = F.col("duration_sim") - F.col("duration_obs")
    lat = F.col(latitude) if latitude else F.lit(None).cast("double")

    def iqr(c: Column) -> Column:
        q = F.percentile(whole_days(c), F.array(F.lit(0.25), F.lit(0.75)))
        return q[1] - q[0]

    return df.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct("PointID").alias("n_locations"),
        F.min("harvest_year").alias("first_year"),
        F.max("harvest_year").alias("last_year"),
        A.small_domain_median(f).alias("flowering_bias_median"),
        A.small_domain_median(d).alias("duration_bias_median"),
        iqr(f).alias("flowering_bias_iqr"),
        iqr(d).alias("duration_bias_iqr"),
        ols_slope(f, "flowering_doy").alias("warmth_slope"),
        F.when(F.count(lat) > MIN_LATITUDE_PAIRS, ols_slope(f, lat)).alias("latitude_slope"),
        ols_slope(f, "harvest_year").alias("year_slope"),
    )


def _build(blocks: Mapping[str, Callable[[], DataFrame]], wanted: Sequence[str] | None) -> dict[str, DataFrame]:
    """Only the wanted blocks; an unknown name is an error."""
    names = list(blocks) if wanted is None else list(wanted)
    return {name: blocks[name]() for name in names}


def diagnose_phenology(
    df: DataFrame, points: DataFrame | None = None, place: str = "PointID", blocks: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Blocks: metrics, structure with verdict, by_year, by_latitude, worst_locations.

    ``points(PointID, Latitude)`` is optional; without it there is no latitude block.
    """
    located = df.join(points.select("PointID", "Latitude"), "PointID") if points is not None else None
    f = F.col("flowering_doy_sim") - F.col("flowering_doy")

    def structure() -> DataFrame:
        one = phenology_structure(df)
        if located is not None:
            slope = located.agg(
                F.when(F.count(F.lit(1)) > MIN_LATITUDE_PAIRS, ols_slope(f, "Latitude")).alias("latitude_slope")
            )
            one = one.drop("latitude_slope").crossJoin(slope)
        return one.withColumn("verdict", phenology_verdict(
            F.col("flowering_bias_median"), F.col("duration_bias_median"), F.col("warmth_slope"), F.col("latitude_slope")
        ))

    def worst() -> DataFrame:
        per = df.groupBy(place).agg(A.small_domain_median(f).alias("flowering_bias"))
        return top_abs(per, "flowering_bias", WORST_PLACES, [place])

    build = {
        "metrics": lambda: union_tagged({k: agreement(df, o, s) for k, (o, s) in STAGES.items()}, "stage"),
        "structure": structure,
        "by_year": lambda: A.bias_table(df, ["harvest_year"], STAGES),
        "worst_locations": worst,
    }
    if located is not None:
        build["by_latitude"] = lambda: A.latitude_bands(located.withColumn("_r", f), "Latitude", "_r", LATITUDE_BANDS)
    return _build(build, blocks)


SHAPE_FEATURES = {
    "peak": ("obs_peak", "sim_peak"), "peak_timing": ("obs_peak_doy", "sim_peak_doy"),
    "peak_stage": ("obs_peak_stage", "sim_peak_stage"), "early_canopy": ("obs_early", "sim_early"),
    "rise_rate": ("obs_rise", "sim_rise"), "decline_rate": ("obs_decline", "sim_decline"),
    "plateau_days": ("obs_plateau_days", "sim_plateau_days"),
}


def season_overview(seasons: DataFrame) -> DataFrame:
    """Seasons, share with a residual of one sign, median and quartiles of season bias."""
    n = seasons.agg(
        F.count(F.lit(1)).alias("n_seasons"),
        (100 * F.avg(F.col("sign_consistent").cast("double"))).alias("sign_consistent_pct"),
    )
    q = exact_quantiles(seasons, [], {"b": "bias"}, [0.25, 0.5, 0.75])
    return n.crossJoin(q).select(
        "n_seasons", "sign_consistent_pct", F.col("b")[0].alias("bias_q25"), F.col("b")[1].alias("bias_median"),
        F.col("b")[2].alias("bias_q75"),
    )


def diagnose_canopy(
    df: DataFrame, edges: Sequence[float], date: str = "date", blocks: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Blocks: overall, years, by_stage, seasons, shape, season_overview, residuals, by_month, places, worst_locations."""
    @cache
    def seasons() -> DataFrame:
        # One row per season, read by three blocks.
        return stage(season_shape(df, ["location", "year"], date, "dvs", "LAI", "LAI_sim"), "seasons")

    return _build({
        "overall": lambda: agreement(df, "LAI", "LAI_sim"),
        "years": lambda: df.select("year").distinct(),
        "by_stage": lambda: A.stage_bin_table(df, "dvs", edges, "LAI", "LAI_sim"),
        "seasons": seasons,
        "shape": lambda: A.difference_summary(seasons(), SHAPE_FEATURES),
        "season_overview": lambda: season_overview(seasons()),
        "residuals": lambda: A.residual_overview(df, "LAI", "LAI_sim", "dvs"),
        "by_month": lambda: A.residual_by_month(df, date, "LAI", "LAI_sim"),
        "places": lambda: A.place_bias_spread(df, "location", "LAI", "LAI_sim"),
        "worst_locations": lambda: top_abs(
            A.place_bias(df, "location", "LAI", "LAI_sim"), "bias", WORST_PLACES, ["location"]
        ),
    }, blocks)


def yield_attribution(df: DataFrame, reference: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Medians of simulated and required harvest index and biomass, plausibility, verdict.

    ``reference`` may give ``harvest_index`` and ``biomass`` ranges.
    """
    ref = reference or {}
    hi_range, agb_range = ref.get("harvest_index", (None, None)), ref.get("biomass", (None, None))
    agb = F.when(F.col("biomass") != 0, F.col("biomass"))
    hi = F.try_divide(F.col("yield_sim"), agb)
    q = exact_quantiles(df, [], {
        "hi": hi, "hi_needed": F.try_divide(F.col("yield"), agb), "agb": agb,
        "agb_needed": F.try_divide(F.col("yield"), F.when(hi != 0, hi)),
    }, [0.5])
    bias = df.agg(F.avg(F.col("yield_sim") - F.col("yield")).alias("bias"))
    med = q.crossJoin(bias).select("bias", *[F.col(c)[0].alias(c) for c in ("hi", "hi_needed", "agb", "agb_needed")])
    flags = med.select(
        "*", in_range("hi", *hi_range).alias("hi_ok"), in_range("agb", *agb_range).alias("agb_ok"),
        in_range("hi_needed", *hi_range).alias("hi_needed_ok"), in_range("agb_needed", *agb_range).alias("agb_needed_ok"),
    )
    verdict = (
        F.when(F.col("hi_ok").isNull() | F.col("agb_ok").isNull(), "no reference ranges given")
        .when(F.abs("bias") < SMALL_YIELD_BIAS, "bias is small")
        .when(F.col("agb_ok") & ~F.col("hi_ok"), "partitioning: harvest index implausible, biomass plausible")
        .when(F.col("hi_ok") & ~F.col("agb_ok"), "biomass: biomass implausible, harvest index plausible")
        .when(F.col("hi_needed_ok") & ~F.col("agb_needed_ok"), "prefer partitioning: only the index can close the gap")
        .when(F.col("agb_needed_ok") & ~F.col("hi_needed_ok"), "prefer biomass: only biomass can close the gap")
        .otherwise("both routes plausible: use drivers and structure")
    )
    return flags.withColumn("verdict", verdict)


def diagnose_yield(
    df: DataFrame, reference: Mapping[str, tuple[float, float]] | None = None, driver_columns: Sequence[str] = (),
    blocks: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Blocks: overall, temporal, by_year, worst_years, spatial, by_state, attribution, drivers, translocation."""
    by_year = A.temporal_decomposition(df, "year", "yield", "yield_sim")
    by_state = A.temporal_decomposition(df, "STATE_NAME", "yield", "yield_sim")
    build = {
        "overall": lambda: agreement(df, "yield", "yield_sim"),
        "by_year": lambda: by_year,
        "temporal": lambda: A.temporal_summary(by_year, "year"),
        "worst_years": lambda: top_abs(by_year, "bias", WORST_YEARS, ["year"]),
        "by_state": lambda: by_state.orderBy("bias"),
        "spatial": lambda: A.spatial_summary(by_state, df, "NUTS_ID", "yield", "yield_sim"),
    }
    if "biomass" in df.columns:
        build["attribution"] = lambda: yield_attribution(df, reference)
    if driver_columns:
        residual = df.withColumn("residual", F.col("yield_sim") - F.col("yield"))
        build["drivers"] = lambda: A.drivers(residual, "residual", driver_columns)
    if "translocated" in df.columns:
        build["translocation"] = lambda: A.compare_series(df, "yield", "yield_sim", "translocated")
    return _build(build, blocks)


def match_coverage(simulated: DataFrame, matched: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Simulated and matched locations, with a warning when too few match."""
    a = simulated.agg(F.count_distinct(key).alias("n_simulated"))
    b = matched.agg(F.count_distinct(key).alias("n_matched"))
    few = F.col("n_matched") < share * F.col("n_simulated")
    return a.crossJoin(b).select(
        "*", F.when(few, "few locations matched: another point set").otherwise("ok").alias("note")
    )
