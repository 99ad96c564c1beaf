"""Numeric column helpers: guards, rounding, clipping, bins, slopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = as_col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    """NaN and infinities become null, so aggregates skip them."""
    return F.when(finite(c), as_col(c))


def finite_pair(a: Column | str, b: Column | str) -> Column:
    return finite(a) & finite(b)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where the denominator is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """The value limited to [low, high]; null stays null."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(as_col(c).isNotNull(), F.greatest(lo, F.least(hi, as_col(c))))


# A value whose magnitude is at most this counts as a structural zero.
STRUCTURAL_ZERO = 1e-12


def value_bounds(
    current: Column | str,
    mode: str = "relative",
    factor: tuple[float, float] = (0.5, 2.0),
    low: float | None = None,
    high: float | None = None,
    clip_to: tuple[float, float] | None = None,
) -> Column:
    """``struct(low, high)`` around a current value.

    Relative bounds scale the value; a structural zero is pinned to [0, 0].
    The current value always stays attainable. A null value has no bounds.
    """
    x = as_col(current).cast("double")
    if mode == "absolute":
        lo, hi = F.lit(float(low)), F.lit(float(high))
    else:
        a, b = x * float(factor[0]), x * float(factor[1])
        lo, hi = F.least(a, b), F.greatest(a, b)
    if clip_to:
        lo, hi = F.greatest(lo, F.lit(float(clip_to[0]))), F.least(hi, F.lit(float(clip_to[1])))
    bounds = F.struct(F.least(lo, x).alias("low"), F.greatest(hi, x).alias("high"))
    if mode == "absolute":
        return F.when(x.isNotNull(), bounds)
    pinned = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    return F.when(F.abs(x) <= STRUCTURAL_ZERO, pinned).when(x.isNotNull(), bounds)


# Largest day number, and difference of days, of a small domain: eleven years.
MOST_DAYS = 4_000


def whole_days(c: Column | str) -> Column:
    """A column of whole days, null where null or NaN; any other value is an error.

    A map of its values and counts has at most ``2 * MOST_DAYS + 1`` entries, however large the group.
    """
    x = as_col(c).cast("double")
    no_days = F.raise_error(F.concat(F.lit("not whole days, use exact_quantiles: "), x.cast("string"))).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when((x == F.floor(x)) & (F.abs(x) <= MOST_DAYS), x).otherwise(no_days)


def edge_bin(c: Column | str, edges: Sequence[float]) -> Column:
    """0-based right-closed bin; the first bin includes its left edge; outside -> null."""
    x = as_col(c)
    out = F.when(x < edges[0], F.lit(None).cast("int"))
    for i, right in enumerate(edges[1:]):
        out = out.when(x <= right, F.lit(i))
    return out


def half_open_edge_bin(c: Column | str, edges: Sequence[float]) -> Column:
    """As ``edge_bin`` but a value on the first edge is outside."""
    return F.when(as_col(c) > edges[0], edge_bin(c, edges))


def equal_bin(c: Column | str, low: Column, high: Column, n: int) -> Column:
    """1-based bin of n equal-width right-closed bins over [low, high].

    The lowest edge is moved down by 0.1 % of the range, so ``low`` itself falls
    into bin 1. A zero-width range puts everything into bin 1; null has no bin.
    """
    x = as_col(c)
    b = F.ceil(F.try_divide((x - low) * n, high - low)).cast("int")
    return F.when(x.isNotNull() & (low == high), F.lit(1)).when(b.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(n), b)))


def histogram_bin(c: Column | str, low: Column, high: Column, n: int) -> Column:
    """0-based left-closed equal bin; the last bin is closed on both sides.

    A zero-width range puts everything into bin 0; null has no bin.
    """
    x = as_col(c)
    b = F.floor(F.try_divide((x - low) * n, high - low)).cast("int")
    return F.when(x.isNotNull() & (low == high), F.lit(0)).when(b.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), b)))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r as an aggregate; null where either side is constant."""
    a, b = as_col(x), as_col(y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ols_slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope over finite pairs; null below 3 pairs or for constant x."""
    ok = finite_pair(x, y)
    a, b = F.when(ok, as_col(x).cast("double")), F.when(ok, as_col(y).cast("double"))
    return F.when((F.count(a) >= 3) & (F.max(a) > F.min(a)), F.regr_slope(b, a))


def saturation_vapour_pressure(temp_c: Column | str) -> Column:
    """kPa over water at a temperature in degrees Celsius (Tetens form)."""
    t = as_col(temp_c)
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + 237.3))


def in_range(value: Column | str, low: Column | float | None, high: Column | float | None) -> Column:
    """True / false against a closed range; null where no range is given."""
    if low is None or high is None:
        return F.lit(None).cast("boolean")
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(lo.isNotNull() & hi.isNotNull(), as_col(value).between(lo, hi))
