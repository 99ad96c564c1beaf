"""Sharding by sampled splitters.

Records are ranges of a hash key of their text, so equal texts stay together as long as that keeps sizes near equal.
Keys are sampled with probability in proportion to their bytes, quantiles of the sample cut the key space into many
ranges, records are range-partitioned, ranges that turn out overfull are subdivided, and whole ranges fill the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A

SHARDS = 24
# Bytes that a record costs besides its text.
OVERHEAD = 8
# Ranges cut for each shard, and expected sampled keys for each range. Their product with the number of shards bounds
# the sample and the list of splitters, whatever the size of the table.
RANGES_PER_SHARD = 96
SAMPLES_PER_RANGE = 4
_SEED = 20_011
# Places are numbered in pieces of 1 << PIECE_BITS places.
PIECE_BITS = 13
# Weighted sampling compares a 40-bit hash with a share of the total.
_UNIT = 1 << 40


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and the fixed cost of a record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _position(splitters: Column, key: Column, count: int) -> Column:
    """How many of the sorted splitters are at or below the key, by binary search."""
    steps = [1 << b for b in reversed(range(max(1, count).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, step: F.when(F.coalesce(F.get(splitters, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low),
    )


def sample_keys(keys: DataFrame, total: int, wanted: int) -> DataFrame:
    """``(key, weight)``: each key with probability min(1, its bytes x wanted / all bytes), weighted by the inverse.

    The draw hashes the key, so a repeated run draws the same. A key that alone fills a range is always drawn.
    """
    share = F.lit(total / wanted)
    drawn = F.pmod(F.xxhash64("key", F.lit(_SEED)), F.lit(_UNIT)) / F.lit(float(_UNIT))
    return keys.filter(drawn < F.col("bytes") / share).select(
        "key", F.greatest(F.col("bytes").cast("double"), share).alias("weight"), (F.col("bytes") >= share).alias("heavy")
    )


def choose_splitters(sample: DataFrame, ranges: int) -> list[int]:
    """Sorted lower ends of ranges: quantile boundaries of the weighted sample, and both ends of every heavy key.

    One task orders the sample, whose expected size is fixed by the parameters; as many numbers reach the driver.
    """
    everything = Window.partitionBy(F.lit(1))
    upto = everything.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sample.withColumns({"upto": F.sum("weight").over(upto), "total": F.sum("weight").over(everything)})
    step = F.col("total") / ranges
    cut = placed.filter(F.col("heavy") | (F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("weight")) / step)))
    ends = F.when(F.col("heavy") & (F.col("key") < (1 << 63) - 1), F.array(F.col("key"), F.col("key") + 1)).otherwise(F.array("key"))
    return [r[0] for r in cut.select(F.explode(ends).alias("key")).distinct().orderBy("key").collect()]


def _part(key: Column, spread: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of the even pieces of a range a record falls into; a range of a single key is dealt out by record."""
    inside = F.floor((key.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double")) * parts)
    return (
        F.when(parts == 1, 0)
        .when(low + 1 == high, F.pmod(spread, parts))
        .otherwise(F.least(F.greatest(inside, F.lit(0)), parts - 1))
        .cast("int")
    )


def _dealt(units: DataFrame, shards: int) -> DataFrame:
    """``(range, unit, shard)``: the largest unit first, each to the shard with the fewest bytes so far.

    The list of units is bounded by the parameters; one row folds over it.
    """
    loads = F.array_repeat(F.lit(0).cast("long"), shards)

    def place(so_far: Column, u: Column) -> Column:
        least = F.array_position(so_far["loads"], F.array_min(so_far["loads"])).cast("int") - 1
        return F.struct(
            F.transform(so_far["loads"], lambda x, i: F.when(i == least, x + u["bytes"]).otherwise(x)).alias("loads"),
            F.concat(so_far["owner"], F.array(least)).alias("owner"),
        )

    # Sorted by falling bytes; range and unit break ties.
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("fewer"), "range", "unit", "bytes")))
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("owner"))
    listed = units.agg(order.alias("units")).select("units", F.aggregate("units", start, place)["owner"].alias("owner"))
    return listed.select(F.explode(F.arrays_zip("units", "owner")).alias("x")).select("x.units.range", "x.units.unit", F.col("x.owner").alias("shard"))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    doc_id: str = "doc_id",
    ranges_per_shard: int = RANGES_PER_SHARD,
    place: str | None = None,
) -> DataFrame:
    """Add ``shard_bytes`` (the record's size), ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    Sizes of shards are near equal: subdivided ranges, about a hundredth of a shard each, go largest first to the shard
    with the fewest bytes. Only a record longer than a shard can make a shard stand out. Rows with equal texts share a
    shard unless they fill over half of one.

    ``place``: a column of longs that slots of a shard follow (ties by the id, then arbitrarily), as the order of a mix; it says
    nothing of the shard. Rows are numbered in pieces of it, so a shard takes as many tasks as it has pieces.

    Every row comes back once, with the columns of ``docs`` except earlier ones of the three names. A null text is a
    group of its own and costs only the fixed bytes; null or repeated ids are ordinary rows (ties in a shard are broken
    by the id, then arbitrarily). An empty table gives an empty result.
    """
    n = A.own_names(docs, "key", "range", "part", "before", "low", "high", "parts", "piece", "owner", "start")
    kept = [c for c in docs.columns if c not in ("shard_bytes", "shard", "slot")]
    # Scattered from the text, so that ranges of keys are fair; equal texts have equal keys.
    records = docs.select(
        *[f"`{c}`" for c in kept], record_size(F.col(f"`{text}`")).alias("shard_bytes"),
        F.xxhash64(F.col(f"`{text}`"), F.lit(_SEED)).alias(n["key"]),
    )
    sizes = stage(records.select(
        F.col(n["key"]).alias("key"), "shard_bytes", F.xxhash64(F.col(f"`{doc_id}`")).alias("spread"),
        *([] if place is None else [F.shiftright(F.col(f"`{place}`"), PIECE_BITS).alias("piece")]),
    ), "shard-sizes")
    ranges = shards * ranges_per_shard
    keys = sizes.groupBy("key").agg(F.sum("shard_bytes").alias("bytes"))
    total = sizes.agg(F.sum("shard_bytes")).first()[0] or 0
    splitters = choose_splitters(sample_keys(keys, total, ranges * SAMPLES_PER_RANGE), ranges)
    cuts = F.array(*[F.lit(s) for s in splitters]) if splitters else F.array().cast("array<bigint>")

    # Exact bytes of the ranges. An overfull one is subdivided evenly: by the key space between its ends or, where one
    # key fills it, by record.
    bounds = sizes.sparkSession.createDataFrame(
        [(k, low, high) for k, (low, high) in enumerate(zip([-(1 << 63), *splitters], [*splitters, (1 << 63) - 1]))],
        "range int, low bigint, high bigint",
    )
    placed = sizes.withColumn("range", _position(cuts, F.col("key"), len(splitters)))
    full = placed.groupBy("range").agg(F.sum("shard_bytes").alias("bytes"))
    goal = F.lit(max(total, 1) / ranges)
    plan = (
        bounds.join(full, "range")
        .withColumn("parts", F.when(F.col("bytes") > 1.5 * goal, F.ceil(F.col("bytes") / goal)).otherwise(1).cast("int"))
        .select("range", "low", "high", "parts")
    )

    # As many rows as ranges, from the splitters: bounded by the parameters.
    plan = F.broadcast(stage(plan, "shard-plan"))
    parted = placed.join(plan, "range").withColumn("part", _part(F.col("key"), F.col("spread"), F.col("low"), F.col("high"), F.col("parts")))
    pieces = (
        parted.groupBy("range", "part").agg(F.sum("shard_bytes").alias("bytes"), F.count("*").alias("rows"))
    )
    # A key that fills whole ranges is dealt in units of up to half a shard, so that few shards hold its copies.
    unit = F.when(F.col("low") + 1 == F.col("high"), F.floor(F.col("part") / (ranges_per_shard // 2 or 1))).otherwise(F.col("part"))
    pieces = stage(pieces.join(plan, "range").select("range", "part", "bytes", "rows", unit.cast("int").alias("unit")), "shard-pieces")
    dealt = pieces.join(_dealt(pieces.groupBy("range", "unit").agg(F.sum("bytes").alias("bytes")), shards), ["range", "unit"])
    in_shard = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("range", "part", "shard", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("before"))
    owners = stage(dealt, "shard-dealt")
    dealt = F.broadcast(owners.withColumnsRenamed({"range": n["range"], "part": n["part"], "before": n["before"]}))

    # The records go to their ranges once, and are numbered inside the subdivided range.
    spread = F.xxhash64(F.col(f"`{doc_id}`"))
    renamed = plan.withColumnsRenamed({c: n[c] for c in ("range", "low", "high", "parts")})
    sent = (
        records.withColumn(n["range"], _position(cuts, F.col(n["key"]), len(splitters)))
        .join(renamed, n["range"])
        .withColumn(n["part"], _part(F.col(n["key"]), spread, F.col(n["low"]), F.col(n["high"]), F.col(n["parts"])))
    )
    if place is not None:
        counted = parted.join(F.broadcast(owners.drop("before")), ["range", "part"]).groupBy("shard", "piece").agg(F.count("*").alias("rows"))
        upto = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        starts = stage(counted.select(
            F.col("shard").alias(n["owner"]), F.col("piece").alias(n["piece"]), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias(n["start"])
        ), "shard-starts")
        owned = sent.join(dealt, [n["range"], n["part"]]).withColumn(n["owner"], F.col("shard"))
        owned = owned.withColumn(n["piece"], F.shiftright(F.col(f"`{place}`"), PIECE_BITS))
        own = Window.partitionBy(n["owner"], n["piece"]).orderBy(F.col(f"`{place}`"), F.col(f"`{doc_id}`"))
        # A null place is a piece of its own, before the others.
        known = starts.withColumnsRenamed({n["owner"]: n["low"], n["piece"]: n["high"]})
        numbered = owned.drop(n["low"], n["high"]).withColumn("slot", F.row_number().over(own))
        numbered = numbered.join(known, (F.col(n["owner"]) == F.col(n["low"])) & F.col(n["piece"]).eqNullSafe(F.col(n["high"])))
        return numbered.select(*[f"`{c}`" for c in kept], "shard_bytes", "shard", (F.col("slot") + F.col(n["start"]) - 1).cast("long").alias("slot"))
    own = Window.partitionBy(n["range"], n["part"]).orderBy(F.col(f"`{doc_id}`"))
    numbered = sent.withColumn("slot", F.row_number().over(own)).join(dealt, [n["range"], n["part"]])
    return numbered.select(*[f"`{c}`" for c in kept], "shard_bytes", "shard", (F.col("slot") + F.col(n["before"]) - 1).cast("long").alias("slot"))
