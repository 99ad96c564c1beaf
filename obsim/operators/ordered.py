"""Order-dependent operators that stay correct and parallel on very large or hot groups.

A window partitioned by a hot key puts that whole key into one task. The
operators here sort by range instead: Spark's range partitioner cuts a hot key
over as many partitions as its rows need. The sorted table is staged once in the
shared folder together with its partition number and the position inside it.
Only the first and the last key of a partition can reach beyond it, so at most
two summary rows a partition are carried forward, and sent to every task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

PART, POS = "_part", "_pos"


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def sorted_stage(df: DataFrame, order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """Range-sort a table, stage it, and add ``_part`` and ``_pos`` (0-based).

    Without ``parts`` the session's shuffle partitions apply, and AQE joins
    neighbouring ranges that turn out small.
    """
    cols = _cols(order)
    ranged = (df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)).sortWithinPartitions(*cols)
    # The generated id holds the partition number above bit 33 and the row
    # position below it.
    marked = ranged.withColumn("_id", F.monotonically_increasing_id()).select(
        *df.columns,
        F.shiftright("_id", 33).cast("int").alias(PART),
        F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias(POS),
    )
    return stage(marked, "sorted")


def number_rows(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_no", start: int = 1
) -> DataFrame:
    """Global consecutive row numbers in sort order, without a single-task window."""
    staged = sorted_stage(df, order)
    sizes = staged.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: at most spark.sql.shuffle.partitions rows.
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return staged.join(F.broadcast(offsets), PART).select(
        *df.columns, (F.col("_before") + F.col(POS) + start).alias(name)
    )


def with_halo(df: DataFrame, order: Sequence[Column | str], back: int, ahead: int, parts: int | None = None) -> DataFrame:
    """Range-sorted rows, each range with copies of the ``back`` rows before and the ``ahead`` rows after it.

    Adds ``_part``, ``_at`` (place in the whole order) and ``_own`` (false for a copy). A window of so many rows inside
    ``_part`` is then the same as over the whole table. Only rows near the ends of ranges are copied; a range that is
    shorter than the halo gets rows of several others.
    """
    staged = sorted_stage(df, order, parts)
    # One row per range: at most the shuffle partitions.
    before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged.groupBy(PART).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = stage(sizes, "ranges")
    ranges = F.broadcast(sizes.agg(F.collect_list(F.struct(PART, "_start", "_n")).alias("_ranges")))
    own = staged.join(F.broadcast(sizes), PART).withColumn("_at", F.col("_start") + F.col(POS))
    edge = own.filter((F.col(POS) < ahead) | (F.col(POS) >= F.col("_n") - back)).crossJoin(ranges)

    def reached(r: Column) -> Column:
        start, end, at = r["_start"], r["_start"] + r["_n"], F.col("_at")
        return (r[PART] != F.col(PART)) & (((at >= start - back) & (at < start)) | ((at >= end) & (at < end + ahead)))

    copies = edge.select(*df.columns, "_at", F.explode(F.filter("_ranges", reached)).alias("_r"))
    return own.select(*df.columns, "_at", PART, F.lit(True).alias("_own")).unionByName(
        copies.select(*df.columns, "_at", F.col(f"_r.{PART}").alias(PART), F.lit(False).alias("_own")))


def _summary(kind: str, c: Column) -> Column:
    if kind == "last":
        return F.max_by(c, F.when(c.isNotNull(), F.col(POS)))
    return {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[kind](c)


def _combine(kind: str, carried: Column, here: Column) -> Column:
    if kind == "min":
        return F.least(carried, here)
    if kind == "max":
        return F.greatest(carried, here)
    if kind == "last":
        return F.coalesce(here, carried)
    both = F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
    return both if kind == "count" else F.when(carried.isNotNull() | here.isNotNull(), both)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, tuple[str, Column | str]],
    inclusive: bool = True,
) -> DataFrame:
    """Running min, max, sum, count or last non-null value within each key.

    ``values`` maps an output name to ``(kind, column)``. With
    ``inclusive=False`` a row sees only the rows before it.
    """
    by = list(by)
    work = df
    for out, (_, expr) in values.items():
        work = work.withColumn(f"_v_{out}", expr if isinstance(expr, Column) else F.col(expr))
    staged = sorted_stage(work, [*by, *order])

    near = staged
    if by:
        key = F.struct(*by)
        # One row a partition: the keys at its ends, the only ones that others hold too.
        ends = staged.groupBy(F.col(PART).alias("_of")).agg(F.min_by(key, POS).alias("_first"), F.max_by(key, POS).alias("_final"))
        near = staged.join(F.broadcast(ends), F.col(PART) == F.col("_of")).filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_final")))
    summary = near.groupBy(PART, *by).agg(
        *[_summary(kind, F.col(f"_v_{out}")).alias(f"_s_{out}") for out, (kind, _) in values.items()]
    )
    keys = [F.col(b) for b in by] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    agg = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    carried = summary.select(
        PART, *[F.col(b).alias(f"_k_{b}") for b in by],
        *[
            (
                F.last(f"_s_{out}", ignorenulls=True) if kind == "last" else agg[kind](f"_s_{out}")
            ).over(before).alias(f"_c_{out}")
            for out, (kind, _) in values.items()
        ],
    )
    edge = 0 if inclusive else -1
    inside = Window.partitionBy(PART, *by).orderBy(POS).rowsBetween(Window.unboundedPreceding, edge)
    local_fn = {
        "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    local = staged
    for out, (kind, _) in values.items():
        local = local.withColumn(f"_l_{out}", local_fn[kind](F.col(f"_v_{out}")).over(inside))
    c = carried.withColumnRenamed(PART, "_k_part")
    same = F.col(PART) == F.col("_k_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    # At most two rows a partition.
    known = reduce(or_, [F.col(f"_c_{out}").isNotNull() for out in values])
    joined = local.join(F.broadcast(c.filter(known)), same, "left")
    return joined.select(
        *df.columns,
        *[
            _combine(kind, F.col(f"_c_{out}"), F.col(f"_l_{out}")).alias(out)
            for out, (kind, _) in values.items()
        ],
    )


def previous(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Values of the preceding row within each key (null on the first row)."""
    packed = F.struct(*[F.col(c) for c in columns])
    out = running(df, by, order, {"_prev": ("last", packed)}, inclusive=False)
    return out.select(*df.columns, *[F.col("_prev")[c].alias(f"{prefix}{c}") for c in columns])
