"""Curve-shape features of a season: peak, rise, decline, plateau, early level.

Everything is an aggregate per (location, season), combined map side, plus one
join with a table of one row a season. No season is sorted in one task, so a
location that holds a large share of all rows is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ols_slope


def _by_year(df: DataFrame, key: Sequence[str], date: str, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Per season and calendar year: rows, least and greatest day of year, and the largest of each of ``more``."""
    return df.groupBy(*key, F.year(date).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.dayofyear(date)).alias("_lo"), F.max(F.dayofyear(date)).alias("_hi"),
        *[F.max(c).alias(f"_{name}") for name, c in (more or {}).items()],
    )


def _turns(per: DataFrame, key: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """``_turn`` per season, the first calendar year that begins below the end of the year before it."""
    # One row per calendar year of a season.
    w = Window.partitionBy(*key).orderBy("_y")
    return per.withColumn("_wraps", F.col("_lo") < F.lag("_hi").over(w)).groupBy(*key).agg(
        F.min(F.when(F.col("_wraps"), F.col("_y"))).alias("_turn"), *more
    )


def _axis(date: str) -> Column:
    shift = F.when(F.year(date) >= F.col("_turn"), 365).otherwise(0)
    return (F.dayofyear(date) + shift).cast("double")


def unrolled_day(df: DataFrame, key: Sequence[str], date: str, name: str = "day") -> DataFrame:
    """Day of year made monotone over new year: +365 from the first decrease on, once.

    In date order a day of year can only decrease where the calendar year
    changes, so the first decrease is found among per-year extremes.
    """
    turn = _turns(_by_year(df, key, date), key)
    return df.join(turn, list(key)).select(*df.columns, _axis(date).alias(name))


def _top(series: str, date: str, stage: str) -> Column:
    # Larger value first, then the earlier date.
    return F.struct(F.col(series).alias("v"), (-F.unix_date(date)).alias("d"), F.col(stage).alias("g"))


def _peak_columns(series: Sequence[str]) -> list[Column]:
    cols = []
    for s in series:
        p = F.col(f"_{s}")
        day = F.date_from_unix_date(-p["d"])
        cols += [
            p["v"].alias(f"{s}_peak"), day.alias(f"{s}_peak_date"),
            F.dayofyear(day).alias(f"{s}_peak_doy"), p["g"].alias(f"{s}_peak_stage"),
        ]
    return cols


def season_peaks(df: DataFrame, key: Sequence[str], date: str, stage: str, series: Sequence[str]) -> DataFrame:
    """Peak value, date and stage per season and series; the earliest maximum wins."""
    got = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.max(_top(s, date, stage)).alias(f"_{s}") for s in series])
    return got.select(*key, "n", *_peak_columns(series))


def season_shape(
    df: DataFrame, key: Sequence[str], date: str, stage: str, obs: str, sim: str, min_points: int = 5
) -> DataFrame:
    """Shape table per season with at least ``min_points`` rows; dates unique per season."""
    key = list(key)
    base = df.select(*key, date, stage, F.col(obs).alias("obs"), F.col(sim).alias("sim"))
    per = _by_year(base, key, date, {v: _top(v, date, stage) for v in ("obs", "sim")})
    # One short row a season: both peaks and the year in which the day axis goes on.
    short = _turns(per, key, [F.sum("_n").alias("n"), *[F.max(f"_{v}").alias(f"_{v}") for v in ("obs", "sim")]])
    peaks = short.filter(F.col("n") >= min_points).select(*key, "n", "_turn", *_peak_columns(["obs", "sim"]))
    rows = base.join(peaks, key).withColumn("day", _axis(date))

    def rise(v: str) -> Column:
        inside = F.col(stage).between(0.2, 1.0)
        return ols_slope(F.when(inside, F.col(v)), F.when(inside, F.col("day")))

    def decline(v: str) -> Column:
        after = F.col(date) > F.col(f"{v}_peak_date")
        return ols_slope(F.when(after, F.col(v)), F.when(after, F.col("day")))

    def plateau(v: str) -> Column:
        high = F.when(F.col(v) >= 0.8 * F.col(f"{v}_peak"), F.col("day"))
        return F.when(F.count(high) >= 2, F.max(high) - F.min(high)).otherwise(F.lit(0.0))

    early = F.col(stage) <= 0.3
    r = F.col("sim") - F.col("obs")
    carried = [c for c in peaks.columns if c not in [*key, "_turn"] and not c.endswith("_date")]
    feats = []
    for v in ("obs", "sim"):
        feats += [
            F.avg(F.when(early, F.col(v))).alias(f"{v}_early"),
            rise(v).alias(f"{v}_rise"),
            decline(v).alias(f"{v}_decline"),
            plateau(v).alias(f"{v}_plateau_days"),
        ]
    return rows.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in carried],
        *feats,
        F.avg(r).alias("bias"),
        (F.every(r > 0) | F.every(r < 0)).alias("sign_consistent"),
    )
