"""Filters, equi-joins, set operations and reshaping."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, finite, whole_days
from .ordered import number_rows
from .quantiles import exact_quantiles

# ---------------------------------------------------------------- projections


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange the contents of two columns."""
    names = {a: b, b: a}
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in df.columns])


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Replace by a dictionary; values outside it pass through."""
    x = as_col(c)
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[x], x)


def lookup_or(c: Column | str, mapping: Mapping, default) -> Column:
    """Look a value up in a dictionary, with a default."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[as_col(c)], F.lit(default))


def sentinel_fallback(c: Column | str, alternative: Column | str, below: float = -99.0) -> Column:
    """The alternative where a value is below the missing-data sentinel."""
    return F.when(as_col(c) < below, as_col(alternative)).otherwise(as_col(c))


def scale_if_raw(
    df: DataFrame, value: str, limit: float = 10.0, factor: float = 0.1, digits: int = 1
) -> DataFrame:
    """Rescale a column when its global maximum shows raw integer units."""
    top = df.agg(F.max(value).alias("_top"))  # one row
    scaled = F.when(F.col("_top") > limit, F.col(value) * factor).otherwise(F.col(value))
    return df.crossJoin(F.broadcast(top)).select(
        *[F.bround(scaled, digits).alias(value) if c == value else F.col(c) for c in df.columns]
    )


# -------------------------------------------------------------------- filters


def valid_sequence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose dates strictly increase; a missing date fails the test."""
    test = F.lit(True)
    for a, b in itertools.pairwise(cols):
        test = test & (F.col(a) < F.col(b))
    return df.filter(F.coalesce(test, F.lit(False)))


def flagged_only(df: DataFrame, flag: str) -> DataFrame:
    """Filter on a flag column if the table has it."""
    return df.filter(F.coalesce(F.col(flag), F.lit(False))) if flag in df.columns else df


def year_window(df: DataFrame, date: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Keep years in a window with open ends; a null date is dropped once a bound is given."""
    y = F.year(date)
    out = df
    if first is not None:
        out = out.filter(y >= first)
    if last is not None:
        out = out.filter(y <= last)
    return out


def clamp_windows(
    df: DataFrame, start: str, end: str, coverage: DataFrame, on: Sequence[str] = (),
    order: Sequence[str] | None = None, number: str | None = None,
) -> DataFrame:
    """Keep windows fully inside ``coverage(on..., first, last)``; optionally renumber them.

    ``coverage`` has one row per source (a single row when ``on`` is empty).
    """
    joined = df.join(coverage, list(on)) if on else df.crossJoin(F.broadcast(coverage))
    kept = joined.filter((F.col(start) >= F.col("first")) & (F.col(end) <= F.col("last"))).select(*df.columns)
    if number is None:
        return kept
    base = kept.drop(number)
    return number_rows(base, order or base.columns, number).select(number, *base.columns)


def dropped_windows(
    df: DataFrame, start: str, end: str, coverage: DataFrame, on: Sequence[str] = ()
) -> DataFrame:
    """Rows, kept and dropped counts of ``clamp_windows`` per source."""
    joined = df.join(coverage, list(on)) if on else df.crossJoin(F.broadcast(coverage))
    inside = (F.col(start) >= F.col("first")) & (F.col(end) <= F.col("last"))
    return joined.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(inside).alias("kept"),
        F.count_if(~inside).alias("dropped"),
    )


def quantile_filter(
    df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99, by: Sequence[str] = (), continuous: bool = False
) -> DataFrame:
    """Keep rows inside the closed quantile range of every column, per group.

    Columns are whole days, whose value -> count maps are bounded (another value is an error), or ``continuous``.
    """
    if continuous:
        bounds = exact_quantiles(df, by, {f"_q_{c}": c for c in cols}, [lo, hi])
    else:
        spec = [F.percentile(whole_days(c), F.array(F.lit(lo), F.lit(hi))).alias(f"_q_{c}") for c in cols]
        bounds = df.groupBy(*by).agg(*spec) if by else df.agg(*spec)
    joined = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    test = F.lit(True)
    for c in cols:
        test = test & F.col(c).between(F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1])
    return joined.filter(test).select(*df.columns)


def flag_prior_year(df: DataFrame, date: Column | str, year: Column | str, name: str = "abnormal") -> DataFrame:
    """True where an event fell in a calendar year before its season's year."""
    return df.withColumn(name, F.coalesce(F.year(as_col(date)) < as_col(year), F.lit(False)))


def drop_flagged(df: DataFrame, flag: str, key: Sequence[str], whole_key: bool = False) -> DataFrame:
    """Drop flagged rows, or every row of a key that has any."""
    if not whole_key:
        return df.filter(~F.col(flag)).drop(flag)
    bad = df.filter(flag).select(*key).distinct()
    return df.join(bad, list(key), "left_anti").drop(flag)


def drop_unusable(df: DataFrame, cols: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a missing value in any column, or a non-positive value in some.

    NaN and infinities are missing too; other types need only a null test, which
    reaches the scan.
    """
    out = df
    kinds = dict(df.dtypes)
    for c in cols:
        out = out.filter(finite(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    for c in positive:
        out = out.filter(F.col(c) > 0)
    return out


def truncate_at(df: DataFrame, key: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Cut each series at its first row meeting a condition, that row included.

    The first crossing is an aggregate (combined map side), so a hot key is
    never sorted in one task. ``order`` must be unique within a key.
    """
    at = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(*key).agg(F.min(F.when(condition, at)).alias("_cut"))
    return (
        df.join(first, list(key))
        .filter(F.col("_cut").isNull() | (at <= F.col("_cut")))
        .select(*df.columns)
    )


# ---------------------------------------------------------------------- joins


def pair(sim: DataFrame, obs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join of simulated and observed rows; null keys never match."""
    return sim.join(obs, list(on), "inner")


def chain_events(
    events: DataFrame,
    keys: Sequence[str],
    phases: Mapping[str, Sequence[str]],
    phase: str = "phase",
    carry: Mapping[str, Sequence[str]] | None = None,
    values: Sequence[str] = ("date", "doy"),
    skip: Sequence[str] = (),
) -> DataFrame:
    """Join one sub-table per phase on the keys: ``{name: phase labels}``.

    Each value column becomes ``<name>_<value>``. ``carry`` names extra columns
    taken from a phase's sub-table. Phases in ``skip`` are left out. Duplicate
    records of a phase multiply, as in any inner join.
    """
    out = None
    for name, labels in phases.items():
        if name in skip:
            continue
        extra = (carry or {}).get(name, [])
        part = events.filter(F.col(phase).isin(*labels)).select(
            *keys, *extra, *[F.col(v).alias(f"{name}_{v}") for v in values]
        )
        out = part if out is None else out.join(part, list(keys), "inner")
    return out


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Attach attributes of a dimension; Spark broadcasts it when its size allows."""
    return df.join(dim, list(on), how)


def keep_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(members, list(on), "left_semi")


def missing_keys(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct required keys that the other table lacks."""
    return required.select(*on).distinct().join(present, list(on), "left_anti")


def assert_covered(required: DataFrame, present: DataFrame, on: Sequence[str]) -> None:
    """Raise with the first ten keys that are required but absent."""
    absent = missing_keys(required, present, on).orderBy(*on).limit(10).collect()
    if absent:
        raise ValueError(f"required keys are absent, first: {[tuple(r) for r in absent]}")


def assert_not_empty(df: DataFrame, what: str = "rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} matched")
    return df


def assert_single_value(df: DataFrame, value: Column | str, what: str = "value"):
    """The one distinct value of a column; several or none is an error."""
    found = df.select(as_col(value).alias("v")).distinct().limit(3).collect()
    if len(found) != 1:
        raise ValueError(f"{what} is not unique: {sorted(r.v for r in found)}")
    return found[0].v


def attach_admin(df: DataFrame, points: DataFrame, on: str, names: Mapping[str, str]) -> DataFrame:
    """Join renamed admin columns; several distinct names per point multiply rows."""
    admin = points.select(*[F.col(a).alias(b) for a, b in names.items()]).dropDuplicates()
    return df.join(admin, on, "inner")


# ----------------------------------------------------- set operations, shapes


def union_tagged(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with the part's key as a column; missing columns become null."""
    out = None
    for key, part in parts.items():
        tagged = part.withColumn(tag, F.lit(key))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def pivot_wide(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence) -> DataFrame:
    """Wide form over a given list of columns; of several values in a cell the largest."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.max(value))


def to_long(df: DataFrame, keep: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per (row, value column)."""
    items = F.array(*[F.struct(F.lit(v).alias("n"), F.col(v).cast("double").alias("v")) for v in values])
    return df.select(*keep, F.explode(items).alias("_i")).select(
        *keep, F.col("_i.n").alias(name), F.col("_i.v").alias(value)
    )


def flatten_lists(df: DataFrame, keep: Sequence[str], name: str, values: str) -> DataFrame:
    """``(name, list)`` to rows named ``name_i``; a list of one element stays ``name``."""
    return df.select(*keep, name, F.size(values).alias("_k"), F.posexplode(values).alias("idx", "value")).select(
        *keep, name, "idx",
        F.when(F.col("_k") > 1, F.concat(name, F.lit("_"), F.col("idx").cast("string")))
        .otherwise(F.col(name)).alias("flat_name"),
        "value",
    )


# Elements of a list that is kept in one row.
MOST_ELEMENTS = 100_000


def chunked_lists(df: DataFrame, keep: Sequence[str], name: str, idx: str = "idx", value: str = "value", chunk: int = MOST_ELEMENTS) -> DataFrame:
    """Inverse of ``flatten_lists`` for lists of any length: ``(name, chunk, values)``, at most ``chunk`` elements in a row."""
    part = F.floor(F.col(idx) / chunk).cast("long").alias("chunk")
    element = F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))
    lists = df.groupBy(*keep, name, part).agg(F.array_sort(F.collect_list(element)).alias("_l"))
    return lists.select(*keep, name, "chunk", F.transform("_l", lambda s: s["v"]).alias("values"))


def unflatten_lists(df: DataFrame, keep: Sequence[str], name: str, idx: str = "idx", value: str = "value") -> DataFrame:
    """Inverse of ``flatten_lists``: one ordered list per parameter; an index beyond ``MOST_ELEMENTS`` is an error."""
    too_long = F.raise_error(F.lit(f"a list of over {MOST_ELEMENTS} elements, use chunked_lists")).cast(df.schema[idx].dataType)
    bounded = df.withColumn(idx, F.when(F.coalesce(F.col(idx) < MOST_ELEMENTS, F.lit(True)), F.col(idx)).otherwise(too_long))
    element = F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))
    lists = bounded.groupBy(*keep, name).agg(F.array_sort(F.collect_list(element)).alias("_l"))
    return lists.select(*keep, name, F.transform("_l", lambda s: s["v"]).alias("values"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in an explicit order (aggregated map side, no window)."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row of each key in an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def in_given_order(df: DataFrame, column: str, order: Sequence, position: str = "position") -> DataFrame:
    """Rows of the requested categories in the requested order; absent ones are null rows."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(order)), f"{position} int, {column} string")
    return wanted.join(df, column, "left").orderBy(position)


def top_abs(df: DataFrame, value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows of largest absolute value, ties by key."""
    return df.orderBy(F.abs(F.col(value)).desc_nulls_last(), *tie).limit(k)
