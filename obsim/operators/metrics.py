"""Agreement metrics between observed and simulated columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, edge_bin, finite_pair, ratio, safe_corr
from ..session import stage


def rmse(obs: Column | str, sim: Column | str) -> Column:
    d = as_col(sim).cast("double") - as_col(obs).cast("double")
    return F.sqrt(F.avg(d * d))


def bias(obs: Column | str, sim: Column | str) -> Column:
    return F.avg(as_col(sim).cast("double") - as_col(obs).cast("double"))


def mae(obs: Column | str, sim: Column | str) -> Column:
    return F.avg(F.abs(as_col(sim).cast("double") - as_col(obs).cast("double")))


def agreement(df: DataFrame, obs: str, sim: str, by: Sequence[str] = ()) -> DataFrame:
    """n, RMSE, MAE, bias, R2, nRMSE % and model efficiency over finite pairs, in one pass.

    Below two pairs only ``n`` is given; a constant side has no R2, a constant
    observation no efficiency.
    """
    ok = finite_pair(obs, sim)
    o = F.when(ok, F.col(obs).cast("double"))
    s = F.when(ok, F.col(sim).cast("double"))
    sums = df.groupBy(*by).agg(
        F.count(o).alias("n"),
        rmse(o, s).alias("_rmse"),
        mae(o, s).alias("_mae"),
        bias(o, s).alias("_bias"),
        safe_corr(o, s).alias("_r"),
        F.avg(o).alias("_mean"),
        F.var_pop(o).alias("_var"),
    )
    full = F.col("n") >= 2
    return sums.select(
        *by, "n",
        F.when(full, F.col("_rmse")).alias("rmse"),
        F.when(full, F.col("_mae")).alias("mae"),
        F.when(full, F.col("_bias")).alias("bias"),
        F.when(full, F.col("_r") * F.col("_r")).alias("r2"),
        F.when(full, F.try_divide(100 * F.col("_rmse"), F.col("_mean"))).alias("nrmse_pct"),
        F.when(
            full & (F.col("_var") > 0), 1 - F.try_divide(F.col("_rmse") * F.col("_rmse"), F.col("_var"))
        ).alias("ef"),
    )


def correlation_metrics(df: DataFrame, obs: str, sim: str, by: Sequence[str] = ()) -> DataFrame:
    """n, Pearson r, RMSE, nRMSE %, bias and MAE; r is null for a constant side."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= 2, safe_corr(obs, sim)).alias("r"),
        rmse(obs, sim).alias("rmse"),
        F.try_divide(100 * rmse(obs, sim), F.avg(obs)).alias("nrmse_pct"),
        bias(obs, sim).alias("bias"),
        mae(obs, sim).alias("mae"),
    )


def stage_loss(df: DataFrame, point: str, stages: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Mean RMSE of two or more dated stages with biases and counts, in one pass.

    ``stages`` maps a name to its (observed, simulated) columns.
    """
    parts = []
    for name, (o, s) in stages.items():
        parts += [rmse(o, s).alias(f"{name}_rmse"), bias(o, s).alias(f"{name}_bias")]
    sums = df.agg(*parts, F.count(F.lit(1)).alias("n"), F.count_distinct(point).alias("locations"))
    mean = sum((F.col(f"{n}_rmse") for n in stages), F.lit(0.0)) / len(stages)
    return sums.select(mean.alias("loss"), "*")


def binned_means(
    df: DataFrame, stage: str, edges: Sequence[float], by: Sequence[str], obs: str, sim: str
) -> DataFrame:
    """Observed and simulated mean per (stage bin, by); rows outside the bins and empty means drop."""
    return (
        df.withColumn("stage_bin", edge_bin(stage, edges))
        .filter(F.col("stage_bin").isNotNull())
        .groupBy("stage_bin", *by)
        .agg(F.avg(obs).alias("obs_mean"), F.avg(sim).alias("sim_mean"))
        .dropna(subset=["obs_mean", "sim_mean"])
    )


def binned_loss(
    df: DataFrame, stage: str, edges: Sequence[float], by: Sequence[str], obs: str, sim: str
) -> DataFrame:
    """RMSE and bias over (stage bin x by) means: every stage weighs the same."""
    return binned_means(df, stage, edges, by, obs, sim).agg(
        rmse("obs_mean", "sim_mean").alias("loss"),
        bias("obs_mean", "sim_mean").alias("bias"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def two_dimension_loss(df: DataFrame, obs: str, sim: str, dim1: str, dim2: str) -> DataFrame:
    """Mean of the RMSE over dim1 means and the RMSE over dim2 means, plus the raw scores.

    One pass over the pairs gives sums per (dim1, dim2); that short table is
    staged, and every score comes from it.
    """
    ok = df.select(
        dim1, dim2, F.col(obs).cast("double").alias("_o"), F.col(sim).cast("double").alias("_s")
    )
    d = F.col("_s") - F.col("_o")
    cells = stage(ok.groupBy(dim1, dim2).agg(
        F.sum("_o").alias("so"), F.sum("_s").alias("ss"),
        F.count("_o").alias("no"), F.count("_s").alias("ns"),
        F.sum(d * d).alias("sq"), F.sum(d).alias("sd"), F.count(d).alias("nd"),
    ), "cells")

    def over(dim: str, name: str) -> DataFrame:
        means = cells.filter(F.col(dim).isNotNull()).groupBy(dim).agg(
            F.try_divide(F.sum("so"), F.sum("no")).alias("o"),
            F.try_divide(F.sum("ss"), F.sum("ns")).alias("s"),
        )
        return means.agg(rmse("o", "s").alias(name))

    raw = cells.agg(
        F.sqrt(F.try_divide(F.sum("sq"), F.sum("nd"))).alias("rmse_raw"),
        F.try_divide(F.sum("sd"), F.sum("nd")).alias("bias"),
        F.try_divide(F.sum("so"), F.sum("no")).alias("mean_obs"),
        F.try_divide(F.sum("ss"), F.sum("ns")).alias("mean_sim"),
        F.sum("nd").alias("n"),
    )
    # Three one-row results.
    joined = over(dim1, f"rmse_{dim1}").crossJoin(over(dim2, f"rmse_{dim2}")).crossJoin(raw)
    loss = (F.col(f"rmse_{dim1}") + F.col(f"rmse_{dim2}")) / 2
    return joined.select(loss.alias("loss"), "*")


def multi_scale(df: DataFrame, scales: Mapping[str, Sequence[str]], obs: str, sim: str) -> DataFrame:
    """Correlation metrics at several scales in one table.

    ``scales`` maps a label to the columns whose means are compared; an empty
    list compares the raw rows. All aggregated scales come from one grouping-sets
    pass over the pairs.
    """
    raw = [label for label, keys in scales.items() if not keys]
    coarse = {label: list(keys) for label, keys in scales.items() if keys}
    parts = []
    if coarse:
        dims = list(dict.fromkeys(c for keys in coarse.values() for c in keys))

        def code(keys: list[str]) -> int:
            # grouping_id() sets a bit, first column highest, for each column left out.
            return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in keys)

        names = F.create_map(*[F.lit(v) for label, keys in coarse.items() for v in (code(keys), label)])
        sets = [[F.col(c) for c in keys] for keys in coarse.values()]
        means = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
            F.grouping_id().cast("int").alias("_g"), F.avg(obs).alias(obs), F.avg(sim).alias(sim)
        )
        parts.append(correlation_metrics(means.withColumn("scale", names[F.col("_g")]), obs, sim, ["scale"]))
    for label in raw:
        parts.append(correlation_metrics(df, obs, sim).withColumn("scale", F.lit(label)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("scale", "n", "r", "rmse", "nrmse_pct", "bias", "mae")


def harvest_index(yield_col: Column | str, biomass: Column | str) -> Column:
    """yield / biomass where biomass is positive."""
    b = as_col(biomass)
    return F.when(b > 0, ratio(yield_col, b))


def translocated_metrics(df: DataFrame, obs: str, plain: str, moved: str) -> DataFrame:
    """Mean, RMSE against observations and ratio of means of the second yield series."""
    return df.agg(
        F.avg(moved).alias("mean_translocated"),
        rmse(obs, moved).alias("rmse_translocated"),
        F.try_divide(F.avg(moved), F.avg(plain)).alias("translocated_ratio"),
    )


def combine(losses: DataFrame, components: DataFrame) -> DataFrame:
    """Weighted scaled objective with each component's contribution and share.

    ``losses(component, loss)`` and ``components(component, weight, scale)`` hold
    a handful of rows. A component without a loss, a non-positive scale or a
    zero weight sum is an error.
    """
    given = components.join(losses, "component", "left").withColumn(
        "loss",
        F.when(F.col("loss").isNull(), F.raise_error(F.concat(F.lit("no loss for component "), "component")).cast("double"))
        .when(F.col("scale") <= 0, F.raise_error(F.concat(F.lit("non-positive scale of "), "component")).cast("double"))
        .otherwise(F.col("loss")),
    )
    part = given.select(
        "component", "loss", "scale", "weight",
        (F.col("loss") / F.col("scale")).alias("scaled"),
        (F.col("weight") * F.col("loss") / F.col("scale")).alias("contribution"),
    )
    total = part.agg(F.sum("contribution").alias("_c"), F.sum("weight").alias("_w"))
    objective = F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).otherwise(
        F.raise_error(F.lit("component weights sum to zero")).cast("double")
    )
    return part.crossJoin(F.broadcast(total)).select(
        "component", "loss", "scale", "weight", "scaled", "contribution",
        objective.alias("objective"),
        F.try_divide(F.col("contribution"), F.col("_c")).alias("share"),
    )
