"""Scored views: phenology, canopy, yield; each a pairing step and a loss."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_day_month_year
from ..functions.numeric import edge_bin
from ..operators.aggregates import district_year
from ..operators.metrics import (
    bias, combine, harvest_index, rmse, stage_loss, translocated_metrics, two_dimension_loss,
)
from ..operators.quantiles import exact_quantiles
from ..operators.relational import assert_not_empty, attach_admin, drop_unusable, flag_prior_year, pair, truncate_at
from ..session import stage

DOY_COLUMNS = ["flowering_doy", "flowering_doy_sim", "maturity_doy", "maturity_doy_sim"]


def phenology_flagged(sim: DataFrame, obs: DataFrame, keys: Sequence[str] = ("PointID", "harvest_year")) -> DataFrame:
    """All complete pairs with the autumn-flowering flag."""
    flagged = flag_prior_year(sim, parse_day_month_year("anthesis_date"), "harvest_year")
    return drop_unusable(pair(flagged, obs, keys), DOY_COLUMNS)


def phenology_pairs(sim: DataFrame, obs: DataFrame, keys: Sequence[str] = ("PointID", "harvest_year")) -> DataFrame:
    """Complete pairs without seasons whose anthesis fell before the harvest year."""
    return phenology_flagged(sim, obs, keys).filter(~F.col("abnormal")).select(
        "*", (F.col("maturity_doy") - F.col("flowering_doy")).alias("duration_obs"),
        (F.col("maturity_doy_sim") - F.col("flowering_doy_sim")).alias("duration_sim"),
    )


def phenology_loss(pairs: DataFrame, point: str = "PointID") -> DataFrame:
    return stage_loss(pairs, point, {
        "flowering": ("flowering_doy", "flowering_doy_sim"), "maturity": ("maturity_doy", "maturity_doy_sim"),
    })


def phenology_score(sim: DataFrame, obs: DataFrame, keys: Sequence[str] = ("PointID", "harvest_year")) -> DataFrame:
    """The phenology loss with ``excluded``: simulated seasons left out because anthesis fell before the harvest year.

    No complete pair at all is an error.
    """
    pairs = assert_not_empty(phenology_pairs(sim, obs, keys), "phenology pairs")
    excluded = flag_prior_year(sim, parse_day_month_year("anthesis_date"), "harvest_year").agg(F.count_if("abnormal").alias("excluded"))
    return phenology_loss(pairs).crossJoin(excluded)  # two one-row results


def canopy_pairs(daily: DataFrame, obs: DataFrame) -> DataFrame:
    """Positive-stage rows up to maturity, joined to observations on location and date."""
    grown = truncate_at(daily.filter(F.col("dvs") > 0), ["location"], ["date"], F.col("dvs") >= 2)
    return pair(grown, obs, ["location", "date"])


def canopy_loss(pairs: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Stage-binned RMSE, raw daily RMSE and counts.

    Sums per (stage bin, year, location) carry all of it, so the daily pairs are
    read once.
    """
    d = F.col("LAI_sim") - F.col("LAI")
    cells = stage(
        pairs.withColumn("stage_bin", edge_bin("dvs", edges)).groupBy("stage_bin", "year", "location").agg(
            F.sum("LAI").alias("so"), F.count("LAI").alias("no"), F.sum("LAI_sim").alias("ss"), F.count("LAI_sim").alias("ns"),
            F.sum(d * d).alias("sq"), F.count(d).alias("nd"), F.count(F.lit(1)).alias("n"),
        ),
        "cells",
    )
    means = cells.filter(F.col("stage_bin").isNotNull()).groupBy("stage_bin", "year").agg(
        F.try_divide(F.sum("so"), F.sum("no")).alias("o"), F.try_divide(F.sum("ss"), F.sum("ns")).alias("s")
    ).dropna(subset=["o", "s"])
    binned = means.agg(rmse("o", "s").alias("loss"), bias("o", "s").alias("bias"), F.count(F.lit(1)).alias("n_groups"))
    raw = cells.agg(
        F.sqrt(F.try_divide(F.sum("sq"), F.sum("nd"))).alias("rmse_daily"), F.sum("n").alias("n_pairs"),
        F.count_distinct("location").alias("locations"),
    )
    return binned.crossJoin(raw)  # two one-row results


def yield_view_pairs(
    sim: DataFrame, points: DataFrame, obs: DataFrame, values: Sequence[str], factor: float = 1.0
) -> DataFrame:
    """Points averaged to district-years and joined to scaled observed districts."""
    placed = attach_admin(
        sim, points, "location", {"location": "location", "NUTS_ID": "NUTS_ID", "STATE_NAME": "STATE_NAME"}
    )
    district = district_year(placed, ["NUTS_ID", "STATE_NAME", "year"], values, "location")
    return pair(district, obs.withColumn("yield", F.col("yield") * factor), ["NUTS_ID", "year"])


def yield_loss(pairs: DataFrame) -> DataFrame:
    return two_dimension_loss(pairs, "yield", "yield_sim", "year", "STATE_NAME")


def canopy_score(daily: DataFrame, obs: DataFrame, edges: Sequence[float]) -> DataFrame:
    """The canopy loss over matched days; no match at all is an error."""
    return canopy_loss(assert_not_empty(canopy_pairs(daily, obs), "canopy pairs"), edges)


def yield_score(sim: DataFrame, points: DataFrame, obs: DataFrame, factor: float = 1.0) -> DataFrame:
    """The yield loss over matched district-years; no match at all is an error."""
    return yield_loss(assert_not_empty(yield_view_pairs(sim, points, obs, ["yield_sim"], factor), "yield pairs"))


def harvest_index_medians(pairs: DataFrame) -> DataFrame:
    """Median simulated and required harvest index, their gap, mean biomass.

    A table without a biomass column has no such metrics: zero rows.
    """
    if "biomass" not in pairs.columns:
        return pairs.sparkSession.createDataFrame([], "hi_sim double, hi_required double, hi_bias double, mean_biomass double")
    q = exact_quantiles(
        pairs, [], {"s": harvest_index("yield_sim", "biomass"), "r": harvest_index("yield", "biomass")}, [0.5]
    )
    mean = pairs.agg(F.avg(F.when(F.col("biomass") > 0, F.col("biomass"))).alias("mean_biomass"))
    return q.crossJoin(mean).select(
        F.col("s")[0].alias("hi_sim"), F.col("r")[0].alias("hi_required"),
        (F.col("s")[0] - F.col("r")[0]).alias("hi_bias"), "mean_biomass",
    )


def yield_translocation(pairs: DataFrame) -> DataFrame:
    return translocated_metrics(pairs, "yield", "yield_sim", "translocated")


# View name -> loss over its pairs, with the loss in column ``loss``.
LOSSES: dict[str, Callable[..., DataFrame]] = {
    "phenology": phenology_loss, "lai": canopy_loss, "yield": yield_loss,
}


def evaluate_stage(losses: Mapping[str, DataFrame], components: DataFrame) -> DataFrame:
    """Score every view and combine them into one objective."""
    rows = None
    for view, loss in losses.items():
        one = loss.select(F.lit(view).alias("component"), "loss")
        rows = one if rows is None else rows.unionByName(one)
    return combine(rows, components)
