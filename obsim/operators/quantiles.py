"""Exact grouped quantiles that never hold one large group's values in one task.

Spark's ``percentile`` keeps a value -> count map per group, so the operators use it on whole days alone (see
``whole_days``). For continuous values ``exact_quantiles`` selects by rank in rounds over a staged table of distinct
values and counts. A slice is a closed range of values that holds a wanted rank; at first it is the whole group. While a
slice holds more values than a task is meant to sort, approximate cut points divide it, the parts are counted, and the
parts that hold a wanted rank are the slices of the next round. What remains is ranked directly. Groups that are small
from the start take no part in the rounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import count_below
from ..session import stage

# Distinct values that a task sorts, and most cut points of a round. Three rounds reach 10^13 values.
TASK_VALUES = 200_000
MOST_CUTS = 1_024
_ROUNDS = 32


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column | str],
    probs: Sequence[float],
    task_values: int = TASK_VALUES,
    most_cuts: int = MOST_CUTS,
) -> DataFrame:
    """One row per key with ``array<double>`` of linear-interpolated quantiles per value.

    Null and NaN values are skipped; a key without any value is absent.
    """
    by = list(by)
    pairs = F.array(*[
        F.struct(
            F.lit(name).alias("m"),
            (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"),
        )
        for name, c in values.items()
    ])
    flat = df.select(*by, F.explode(pairs).alias("_p")).select(
        *by, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v")
    )
    g = [*by, "_m"]
    # Copies collapse to counts map side, so a hot value costs one row per task.
    counts = stage(
        flat.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_n")),
        "values",
    )
    hits = _hits(counts, g, probs, task_values, most_cuts)

    def at(rank: str) -> Column:
        inside = (F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end"))
        return F.max(F.when(inside, F.col("_v")))

    q = hits.groupBy(*g, "_i").agg(
        at("_lo").alias("_a"), at("_hi").alias("_z"), F.max("_h").alias("_h")
    ).select(*g, "_i", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("_q"))

    def of(name: str, i: int) -> Column:
        return F.max(F.when((F.col("_m") == name) & (F.col("_i") == i), F.col("_q")))

    exprs = [F.array(*[of(name, i) for i in range(len(probs))]).alias(name) for name in values]
    return q.groupBy(*by).agg(*exprs)


def _ranks(probs: Sequence[float]) -> Column:
    """``array<struct<_i, _h, _lo, _hi>>``: wanted 0-based ranks of each probability."""
    def one(i: int, p: float) -> Column:
        h = (F.col("_total") - 1) * F.lit(float(p))
        return F.struct(F.lit(i).alias("_i"), h.alias("_h"), F.floor(h).alias("_lo"), F.ceil(h).alias("_hi"))

    return F.array(*[one(i, p) for i, p in enumerate(probs)])


def _hits(counts: DataFrame, g: Sequence[str], probs: Sequence[float], task_values: int, most_cuts: int) -> DataFrame:
    """Values at and around the wanted ranks, with their rank interval [_start, _end)."""
    whole = counts.groupBy(*g).agg(
        F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_total")
    )
    whole = whole.select(*g, "_first", "_last", F.lit(0).cast("bigint").alias("_below"), "_k", _ranks(probs).alias("_want"))
    slices = stage(whole, "slices")
    small = slices.filter(F.col("_k") <= task_values)
    for _ in range(_ROUNDS):
        large = slices.filter(F.col("_k") > task_values)
        longest = large.agg(F.max("_k").alias("k")).first().k
        if longest is None:
            break
        slices = stage(_narrowed(counts, large, g, min(most_cuts, 2 * -(-longest // task_values))), "slices")
        small = small.unionByName(slices.filter(F.col("_k") <= task_values))
    else:
        raise RuntimeError("a slice does not get smaller")
    rows = _inside(counts, small, g, "_below", "_want")
    within = Window.partitionBy(*g, "_first").orderBy("_v")
    end = F.col("_below") + F.sum("_n").over(within)
    ranked = rows.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    return ranked.select(*g, "_v", "_start", "_end", F.explode("_want").alias("_w")).select(*g, "_v", "_start", "_end", "_w.*")


def _inside(counts: DataFrame, slices: DataFrame, g: Sequence[str], *carried: str) -> DataFrame:
    """Values of the slices. A group has at most two slices for each probability."""
    right, same = _null_safe(slices.select(*g, "_first", "_last", *carried), g)
    joined = counts.join(right, same & F.col("_v").between(F.col("_first"), F.col("_last")))
    return joined.select(*g, "_v", "_n", "_first", *carried)


def _narrowed(counts: DataFrame, large: DataFrame, g: Sequence[str], cuts: int) -> DataFrame:
    """The parts of large slices that hold a wanted rank."""
    key = [*g, "_first"]
    grid = [i / cuts for i in range(1, cuts)]
    # Approximate cuts depend on the order of merging and are used twice, so they are fixed once: a row for each slice.
    cut = _inside(counts, large, g).groupBy(*key).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", grid, 10_000))).alias("_cuts"))
    right, same = _null_safe(cut, key)
    cut = stage(large.join(right, same).select(*key, "_last", "_below", "_want", "_cuts"), "cuts")
    parts = _inside(counts, cut, g, "_below", "_want", "_cuts").withColumn("_b", count_below("_cuts", "_v", cuts))
    # At most as many rows as cuts for a slice.
    per = parts.groupBy(*key, "_b").agg(
        F.min("_v").alias("_from"), F.max("_v").alias("_last"), F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_size"),
        F.first("_below").alias("_below"), F.first("_want").alias("_want"),
    )
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_size").over(before), F.lit(0)))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_size"))

    wanted = per.withColumn("_want", F.filter("_want", lambda r: holds(r["_lo"]) | holds(r["_hi"]))).filter(F.size("_want") > 0)
    return wanted.select(*g, F.col("_from").alias("_first"), "_last", "_below", "_k", "_want")


def _null_safe(right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column]:
    """The right side with renamed keys, and a join condition where null equals null."""
    cond = F.lit(True)
    for k in on:
        right = right.withColumnRenamed(k, f"_r_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return right, cond
