"""Deterministic sampling, even spacing, balanced task buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import number_rows
from .relational import keep_members


def stratified_two_phase(
    df: DataFrame, block: str, cls: str, key: Sequence[str], per_block: int = 100, per_class: int = 500,
    seed: int = 42, order: Sequence[Column] | None = None,
) -> DataFrame:
    """At most ``per_block`` rows per (block, class), then ``per_class`` per class.

    The draw orders rows by a seeded hash of their key, so it is repeatable.
    ``row_number() <= k`` lets Spark prune every (block, class) to k rows before
    the shuffle, so a dominant class sends no more than that from any task.
    """
    draw = list(order) if order else [F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), *[F.col(k) for k in key]]
    first = Window.partitionBy(block, cls).orderBy(*draw)
    second = Window.partitionBy(cls).orderBy(*draw)
    return (
        df.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_block)
        .withColumn("_r", F.row_number().over(second)).filter(F.col("_r") <= per_class)
        .drop("_r")
    )


def evenly_spaced_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """n keys at even positions of the sorted distinct keys (all of them if fewer)."""
    keys = number_rows(df.select(key).distinct(), [key], "_rank", start=0)
    total = keys.agg(F.count(F.lit(1)).alias("_total"))
    step = (F.col("_total") - 1).cast("double") / F.lit(float(max(n - 1, 1)))
    at = F.when(F.col("_i") == n - 1, F.col("_total") - 1).otherwise(F.floor(F.col("_i") * step))
    picks = total.select("_total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")).select(
        "_total", (at if n > 1 else F.lit(0)).cast("bigint").alias("_at")
    )
    # n positions: a literal-sized table.
    chosen = keys.join(F.broadcast(picks.select("_at").distinct()), F.col("_rank") == F.col("_at"), "left_semi")
    everything = keys.crossJoin(F.broadcast(total)).filter(F.col("_total") <= n)
    return chosen.select(key).union(everything.select(key)).distinct()


def evenly_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of n evenly spaced keys."""
    return keep_members(df, evenly_spaced_keys(df, key, n), [key])


def first_groups(df: DataFrame, key: str, n: int, order: Column | str | None = None) -> DataFrame:
    """Rows of the first n keys in order."""
    keys = df.groupBy(key).agg(F.min(order if order is not None else key).alias("_o")).orderBy("_o", key).limit(n)
    return keep_members(df, keys, [key])


def balanced_buckets(df: DataFrame, key: str, n: int, name: str = "bucket") -> DataFrame:
    """Contiguous ranges of the sorted keys with near-equal key counts; a key is never cut.

    Bucket b holds the key positions from trunc(b*K/n) to trunc((b+1)*K/n) - 1.
    """
    ranked = number_rows(df.select(key).distinct(), [key], "_rank", start=0)
    total = ranked.agg(F.count(F.lit(1)).alias("_total"))
    # Largest b with trunc(b*K/n) <= rank.
    bucket = F.floor(((F.col("_rank") + 1) * n - 1) / F.col("_total")).cast("int")
    of = ranked.crossJoin(F.broadcast(total)).select(key, F.least(bucket, F.lit(n - 1)).alias(name))
    return df.join(of, key)


def bucket_ranges(bucketed: DataFrame, key: str, name: str = "bucket") -> DataFrame:
    """First key, last key, keys and rows per bucket."""
    return bucketed.groupBy(name).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"),
        F.count_distinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_rows"),
    )


def even_ranges(start: int, end: int, n: int) -> list[tuple[int, int]]:
    """Split the closed range into at most n nearly equal closed ranges."""
    size = end + 1 - start
    cuts = [start + i * size // n for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:]) if a < b]


def contiguous_layout(df: DataFrame, key: str, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Range-partition on a key and sort inside, so each key's rows are contiguous."""
    ranged = df.repartitionByRange(parts, key, *order) if parts else df.repartitionByRange(key, *order)
    return ranged.sortWithinPartitions(key, *order)
