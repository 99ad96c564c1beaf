"""Table-quality rules over long tables ``(group, idx, value)``.

Each rule returns violations ``(rule, group..., idx, message parts)``; an empty
result means the table is fine. Neighbouring elements come from
``ordered.previous``, which stays parallel when one group is very large.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import STRUCTURAL_ZERO
from ..session import stage
from .ordered import previous
from .series import interpolate_within


def _out(df: DataFrame, rule: str, group: Sequence[str], *cols) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), *group, *cols)


def check_bounds(df: DataFrame, group: Sequence[str], idx: str, value: str, bounds: DataFrame | None = None,
                 low: Column | float | None = None, high: Column | float | None = None, on: Sequence[str] | None = None) -> DataFrame:
    """Values outside their bounds; from columns, literals or a joined bounds table."""
    rows = df.join(bounds, list(on or [*group, idx])) if bounds is not None else df
    lo = F.col("low") if low is None else (low if isinstance(low, Column) else F.lit(float(low)))
    hi = F.col("high") if high is None else (high if isinstance(high, Column) else F.lit(float(high)))
    bad = rows.withColumn("_lo", lo).withColumn("_hi", hi).filter(
        (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))
    )
    return _out(bad, "bounds", group, idx, value, F.col("_lo").alias("low"), F.col("_hi").alias("high"))


def check_smooth(df: DataFrame, group: Sequence[str], idx: str, value: str, max_ratio: float = 2.0) -> DataFrame:
    """Neighbours whose magnitudes differ by more than a ratio; near-zero pairs are skipped."""
    p = previous(df, group, [idx], [idx, value])
    a, b = F.abs(F.col(f"prev_{value}")), F.abs(F.col(value))
    lo, hi = F.least(a, b), F.greatest(a, b)
    step = F.try_divide(hi, lo)
    bad = p.filter(F.col(f"prev_{value}").isNotNull() & (lo > STRUCTURAL_ZERO) & (step > max_ratio))
    return _out(bad, "smooth", group, idx, F.col(f"prev_{idx}").alias("prev_idx"), step.alias("step"))


def check_monotone(
    df: DataFrame, group: Sequence[str], idx: str, value: str, direction: str = "non_decreasing",
    tolerance: float = 0.0, position: str | None = None, from_x: float | None = None,
) -> DataFrame:
    """Steps against the direction beyond a tolerance, optionally only from a grid position on."""
    rows = df.filter(F.col(position) >= from_x) if from_x is not None else df
    p = previous(rows, group, [idx], [idx, value])
    delta = F.col(value) - F.col(f"prev_{value}")
    test = delta > tolerance if direction == "non_increasing" else delta < -tolerance
    return _out(p.filter(test), "monotone", group, idx, F.col(f"prev_{idx}").alias("prev_idx"), delta.alias("delta"))


def check_endpoint(df: DataFrame, group: Sequence[str], idx: str, value: str, rule: str = "last_le_max", tolerance: float = 0.0) -> DataFrame:
    """The last element against the largest earlier one, or against the first."""
    ends = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.max(idx).alias("_last_i"),
        F.max_by(value, idx).alias("last_value"), F.min_by(value, idx).alias("first_value"),
    )
    if rule == "last_le_first":
        bad = ends.filter(F.col("last_value") > F.col("first_value") + tolerance)
        return _out(bad, rule, group, "last_value", F.col("first_value").alias("limit"))
    earlier = (
        df.join(ends.select(*group, "_last_i"), list(group))
        .groupBy(*group).agg(F.max(F.when(F.col(idx) < F.col("_last_i"), F.col(value))).alias("limit"))
    )
    bad = ends.join(earlier, list(group)).filter((F.col("n") > 1) & (F.col("last_value") > F.col("limit") + tolerance))
    return _out(bad, rule, group, "last_value", "limit")


def closure_sums(df: DataFrame, group: Sequence[str], member: str, x: str, value: str) -> DataFrame:
    """Sum of linearly interpolated members on the union of their grids, per group.

    A member has at most one knot per position. Where every member of a group
    has a knot, the sum needs no interpolation; only positions that some member
    lacks are interpolated, and only for that member.
    """
    group = list(group)
    # Staged, so that whatever produces the elements runs once.
    knots = stage(df.select(*group, member, F.col(x).alias("node"), F.col(value).alias("_y")), "closure-knots")
    members = knots.select(*group, member).distinct()
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_members"))
    nodes = stage(
        knots.groupBy(*group, "node").agg(F.sum("_y").alias("_sum"), F.count("_y").alias("_have")).join(sizes, group),
        "nodes",
    )
    full = nodes.filter(F.col("_have") == F.col("_members")).select(*group, "node", F.col("_sum").alias("total"))
    partial = nodes.filter(F.col("_have") < F.col("_members"))
    if partial.isEmpty():
        return full
    gaps = partial.select(*group, "node").join(members, group).join(
        knots.select(*group, member, "node"), [*group, member, "node"], "left_anti"
    )
    used = knots.join(partial.select(*group).distinct(), group, "left_semi")
    filled = interpolate_within(gaps, "node", used, [*group, member], "node", "_y", "_v")
    extra = filled.groupBy(*group, "node").agg(F.sum("_v").alias("_extra"))
    rest = partial.join(extra, [*group, "node"]).select(*group, "node", (F.col("_sum") + F.col("_extra")).alias("total"))
    return full.unionByName(rest)


def check_closure(before: DataFrame, after: DataFrame, group: Sequence[str], member: str, x: str, value: str, tolerance: float = 0.005) -> DataFrame:
    """Nodes where the members no longer sum to 1, only where they did before.

    Where all members of a group have the same knots, one sum for each node and table is all; a pass over these sums
    decides it. Otherwise members are interpolated.
    """
    both = before.select(*group, member, x, value, F.lit(0).alias("_when")).unionByName(
        after.select(*group, member, x, value, F.lit(1).alias("_when"))
    )
    sums, even = [], []
    for when, name in ((0, "_b"), (1, "total")):
        at = F.col("_when") == when
        sums += [
            F.sum(F.when(at, F.col(value))).alias(name), F.count(F.when(at, F.col(value))).alias(f"_have{when}"),
            # The members of a node, by hash; 40 bits, so that sums do not overflow.
            F.sum(F.when(at, F.shiftrightunsigned(F.xxhash64(member), 24))).alias(f"_who{when}"), F.count_if(at).alias(f"_rows{when}"),
        ]
        present = F.col(f"_rows{when}") > 0
        for c in (f"_have{when}", f"_who{when}", f"_rows{when}"):
            even.append(F.min(F.when(present, F.col(c))).eqNullSafe(F.max(F.when(present, F.col(c)))))
        even.append(F.coalesce(F.bool_and(F.col(f"_have{when}") == F.col(f"_rows{when}")), F.lit(True)))
    nodes = both.groupBy(*group, F.col(x).alias("node")).agg(*sums)
    gaps = nodes.groupBy(*group).agg(functools.reduce(lambda a, b: a & b, even).alias("_even")).filter(~F.col("_even"))
    if gaps.isEmpty():
        sums = nodes.select(*group, "node", "_b", "total")
    else:
        sums = closure_sums(both, [*group, "_when"], member, x, value).groupBy(*group, "node").agg(
            F.max(F.when(F.col("_when") == 0, F.col("total"))).alias("_b"),
            F.max(F.when(F.col("_when") == 1, F.col("total"))).alias("total"),
        )
    sums = sums.filter(F.col("total").isNotNull()).withColumn("before_total", F.coalesce("_b", "total"))
    bad = sums.filter(
        (F.abs(F.col("before_total") - 1) <= tolerance) & (F.abs(F.col("total") - 1) > tolerance)
    )
    return _out(bad, "closure", group, "node", "before_total", "total")


def changes(before: DataFrame, after: DataFrame, on: Sequence[str], value: str, atol: float = 1e-12) -> DataFrame:
    """Elements of ``after`` that differ from ``before`` or are new."""
    b = before.select(*on, F.col(value).alias("old"))
    return after.select(*on, F.col(value).alias("new")).join(b, list(on), "left").filter(
        F.col("old").isNull() | (F.abs(F.col("new") - F.col("old")) > atol)
    )


def check_max_changed(before: DataFrame, after: DataFrame, group: Sequence[str], param: str, idx: str, value: str,
                      limit: int = 3, max_elements: int | None = None) -> DataFrame:
    """Groups that change more parameters or elements than allowed."""
    c = changes(before, after, [*group, param, idx], value).groupBy(*group).agg(
        F.count_distinct(param).alias("n_params"), F.count(F.lit(1)).alias("n_elements")
    )
    test = F.col("n_params") > limit
    if max_elements is not None:
        test = test | (F.col("n_elements") > max_elements)
    return _out(c.filter(test), "max_changed", group, "n_params", "n_elements")


def check_step(before: DataFrame, after: DataFrame, on: Sequence[str], value: str, max_fraction: float = 0.5) -> DataFrame:
    """Elements that move by more than a fraction of their old value; zeros are skipped."""
    b = before.select(*on, F.col(value).alias("old"))
    moved = F.try_divide(F.abs(F.col("new") - F.col("old")), F.abs(F.col("old")))
    rows = after.select(*on, F.col(value).alias("new")).join(b, list(on))
    bad = rows.filter((F.abs(F.col("old")) > STRUCTURAL_ZERO) & (moved > max_fraction + 1e-9))
    return _out(bad, "step", on, "old", "new", moved.alias("moved"))


_OPERATORS = {
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def check_ordering(df: DataFrame, group: Sequence[str], name: str, value: str, left: str, op: str, right: str) -> DataFrame:
    """Groups where ``left op right`` fails; a group lacking either key is skipped."""
    both = df.filter(F.col(name).isin(left, right)).groupBy(*group).agg(
        F.max(F.when(F.col(name) == left, F.col(value))).alias("left_value"),
        F.max(F.when(F.col(name) == right, F.col(value))).alias("right_value"),
    )
    bad = both.filter(~_OPERATORS[op](F.col("left_value"), F.col("right_value")))
    return _out(bad, "ordering", group, "left_value", "right_value")


def row_digests(df: DataFrame, group: Sequence[str], key: Sequence[str], value: str) -> DataFrame:
    """Order-independent digest per group: count and sums of row hashes, merged map side.

    Sums of two differently seeded hashes: repeated rows add up instead of cancelling.
    """
    columns = [*[F.col(k) for k in key], F.col(value)]

    def total(*seed: Column) -> Column:
        return F.sum(F.xxhash64(*seed, *columns).cast("decimal(20,0)")).cast("string")

    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws(":", total(), total(F.lit(1))).alias("digest"),
    )


def check_protected(snapshot: DataFrame, now: DataFrame, on: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Protected elements that changed, appeared or vanished since the snapshot.

    Both tables are tagged and aggregated by key, so a missing side is a null
    and no outer join is needed.
    """
    tagged = snapshot.select(*on, F.col(value).alias("was"), F.lit(None).cast("double").alias("is_now")).unionByName(
        now.select(*on, F.lit(None).cast("double").alias("was"), F.col(value).alias("is_now"))
    )
    both = tagged.groupBy(*on).agg(F.max("was").alias("was"), F.max("is_now").alias("is_now"))
    same = F.col("was").eqNullSafe(F.col("is_now")) | F.coalesce(
        F.abs(F.col("was") - F.col("is_now")) <= tolerance, F.lit(False)
    )
    return _out(both.filter(~same), "protected", on, "was", "is_now")


def locked_elements(space: DataFrame, group: Sequence[str], member: str, node: str, low: str = "low", high: str = "high") -> DataFrame:
    """Movable elements that no other member can compensate at the same node.

    Only groups whose members share one grid are decided.
    """
    movable = (F.col(high) - F.col(low)) > STRUCTURAL_ZERO
    shape = space.groupBy(*group).agg(
        F.count_distinct(member).alias("_m"), F.count_distinct(node).alias("_k"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_m") * F.col("_k") == F.col("_n"))
    per_node = space.groupBy(*group, node).agg(F.count_if(movable).alias("_movable"))
    lone = per_node.filter(F.col("_movable") == 1).join(shape.select(*group), list(group), "left_semi")
    return space.filter(movable).join(lone.drop("_movable"), [*group, node], "left_semi")


def offered_space(space: DataFrame, protected: DataFrame, on: Sequence[str]) -> DataFrame:
    """The space without protected keys: protection wins."""
    return space.join(protected.select(*on).distinct(), list(on), "left_anti")
