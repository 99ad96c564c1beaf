"""Array column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def _slice(arr: Column | str, first: int, last: int) -> Column:
    return F.slice(as_col(arr), F.lit(first), F.lit(last - first + 1))


def slice_sum(arr: Column | str, first: int, last: int) -> Column:
    """Sum of elements first..last, 1-based, both ends included."""
    return F.aggregate(_slice(arr, first, last), F.lit(0.0), lambda a, x: a + x.cast("double"))


def slice_avg(arr: Column | str, first: int, last: int) -> Column:
    """Mean of elements first..last; null for an empty slice."""
    return F.try_divide(slice_sum(arr, first, last), F.size(_slice(arr, first, last)).cast("double"))


def edit_at(arr: Column | str, edits: Column | str) -> Column:
    """Replace elements named by a ``map<index text, value>``; a bad index is an error."""
    a, e = as_col(arr), as_col(edits)
    n = F.size(a)
    bad = F.exists(F.map_keys(e), lambda k: F.coalesce((k.try_cast("int") < 0) | (k.try_cast("int") >= n), F.lit(True)))
    edited = F.transform(a, lambda x, i: F.coalesce(F.try_element_at(e, i.cast("string")), x))
    return F.when(~bad, edited).otherwise(
        F.raise_error(F.lit("index out of range of the array")).cast("array<double>")
    )


def replace_all(arr: Column | str, values: Column | str) -> Column:
    """A full new list; a different length is an error."""
    a, v = as_col(arr), as_col(values)
    return F.when(F.size(a) == F.size(v), v).otherwise(
        F.raise_error(F.lit("list length differs from the current array")).cast("array<double>")
    )


def changed_indices(old: Column | str, new: Column | str, atol: float = 1e-12) -> Column:
    """0-based positions of ``new`` that differ from ``old`` by more than a tolerance."""
    o, v = as_col(old), as_col(new)
    flags = F.transform(
        v,
        lambda x, i: F.when(
            (i >= F.size(o)) | (F.abs(x - F.try_element_at(o, i + 1)) > atol), i
        ),
    )
    return F.filter(flags, lambda i: i.isNotNull())


def count_below(sorted_values: Column | str, x: Column | str, most: int) -> Column:
    """How many of up to ``most`` sorted values are less than ``x``, by binary search."""
    values, own = as_col(sorted_values), as_col(x)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(values, low + step - 1) < own, F.lit(False)), low + step).otherwise(low)
    )
