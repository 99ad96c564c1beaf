"""Regular series: centred means, seasonal cycle, interpolation, splice, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..session import stage
from .ordered import running, with_halo
from .relational import missing_keys

# Most knots one lookup cell may hold before the sorted path takes over.
CELL_KNOTS = 64
# Most knots the lookup path may pair up in one sorted list.
MAX_LOOKUP_KNOTS = 100_000


def _month_index():
    return (F.col("year") * 12 + F.col("month") - 1).cast("int")


def centred_mean(df: DataFrame, value: str, order: Sequence[str], n: int = 12, by: Sequence[str] = (), name: str = "centred",
                 parts: int | None = None) -> DataFrame:
    """Centred moving mean over full windows of n rows.

    For an even n the window reaches one row further back than forward. A series may be of any length, with a key or
    without: ranges of it (``parts``, by default as many as the session shuffles to) also get the rows next to them.
    """
    back, ahead = n // 2, n - n // 2 - 1
    ranges = with_halo(df, [*by, *order], back, ahead, parts)
    w = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(-back, ahead)
    mean = ranges.withColumn(name, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))
    return mean.filter("_own").select(*[c for c in df.columns if c != name], name)


def seasonal_cycle(df: DataFrame, y0: int, y1: int, value: str = "average") -> DataFrame:
    """``(month, cycle)``: mean deviation from the centred 12-month mean over y0..y1, summing to zero."""
    dev = centred_mean(df, value, ["year", "month"]).select(
        "year", "month", (F.col(value) - F.col("centred")).alias("_d")
    )
    per = dev.filter(F.col("year").between(y0, y1)).groupBy("month").agg(F.avg("_d").alias("_c"))
    mean = per.agg(F.avg("_c").alias("_m"))
    return per.crossJoin(F.broadcast(mean)).select("month", (F.col("_c") - F.col("_m")).alias("cycle"))


def deseasonalise(df: DataFrame, cycle: DataFrame, value: str = "average") -> DataFrame:
    """Series minus its cycle on decimal years; the cycle has at most 12 rows."""
    return df.join(F.broadcast(cycle), "month", "left").select(
        "year", "month", decimal_year("year", "month").alias("x"),
        (F.col(value) - F.col("cycle")).alias("value"),
    )


def interpolate(
    df: DataFrame, x: str, knots: DataFrame, kx: str, ky: str, name: str = "interpolated"
) -> DataFrame:
    """Linear interpolation of knots at x; ends are held flat, a null x gives null, tied knots count as their mean.

    Knot intervals are looked up through equal-width cells (an equi-join). When
    knots cluster so that a cell would hold many, a sorted merge with carried
    knots is used instead; both are exact.
    """
    # Staged, so that whatever produces the knots runs once.
    k = stage(_single_knots(knots, [], kx, ky), "knots")
    span = k.agg(F.min("_kx").alias("lo"), F.max("_kx").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if span.n == 0:
        return df.withColumn(name, F.lit(None).cast("double"))
    if span.n == 1 or span.lo == span.hi:
        return df.withColumn(name, F.when(F.col(x).isNotNull(), F.lit(k.first()["_ky"])))
    width = (span.hi - span.lo) / span.n
    fullest = (
        k.groupBy(F.floor((F.col("_kx") - span.lo) / width)).count().agg(F.max("count").alias("m")).first().m
    )
    if fullest > CELL_KNOTS or span.n > MAX_LOOKUP_KNOTS:
        return _interpolate_sorted(df, x, k, name)
    segments = _segments(k)
    cells = segments.withColumn(
        "_cell",
        F.explode(F.sequence(
            F.floor((F.col("x0") - span.lo) / width), F.floor((F.col("x1") - span.lo) / width)
        )),
    )
    clamped = F.when(
        F.col(x).isNotNull(), F.greatest(F.lit(float(span.lo)), F.least(F.lit(float(span.hi)), F.col(x).cast("double")))
    )
    left = df.withColumn("_x", clamped).withColumn("_cell", F.floor((F.col("_x") - span.lo) / width))
    inside = (
        (left["_cell"] == cells["_cell"])
        & (F.col("_x") >= F.col("x0"))
        & ((F.col("_x") < F.col("x1")) | (F.col("_x") == F.lit(float(span.hi))) & (F.col("x1") == F.lit(float(span.hi))))
    )
    return left.join(cells, inside, "left").select(*df.columns, _line().alias(name))


def _single_knots(knots: DataFrame, on: Sequence[str], kx: str, ky: str) -> DataFrame:
    """``(on..., _kx, _ky)`` with one knot for each place: tied knots count as their mean, incomplete ones not at all."""
    k = knots.select(*on, F.col(kx).cast("double").alias("_kx"), F.col(ky).cast("double").alias("_ky"))
    return k.filter("_kx is not null and _ky is not null").groupBy(*on, "_kx").agg(F.avg("_ky").alias("_ky"))


def _segments(k: DataFrame) -> DataFrame:
    """Consecutive knot pairs of a checked short list (at most MAX_LOOKUP_KNOTS)."""
    w = Window.partitionBy(F.lit(0)).orderBy("_kx")
    return k.select(
        F.col("_kx").alias("x0"), F.col("_ky").alias("y0"),
        F.lead("_kx").over(w).alias("x1"), F.lead("_ky").over(w).alias("y1"),
    ).filter("x1 IS NOT NULL")


def _line():
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return F.col("y0") + slope * (F.col("_x") - F.col("x0"))


def _interpolate_sorted(df: DataFrame, x: str, k: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Carry the nearest knot forward and backward over the sorted union of rows and knots.

    ``k`` holds ``by``, ``_kx`` and ``_ky``. Range sorting keeps a key with very
    many rows or knots spread over tasks.
    """
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.struct(*df.columns).alias("_row"))
    both = rows.withColumn("_k", F.lit(None).cast("struct<x:double,y:double>")).unionByName(
        k.select(
            *by, F.col("_kx").alias("_x"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
            F.struct(F.col("_kx").alias("x"), F.col("_ky").alias("y")).alias("_k"),
        )
    )
    is_row = F.col("_row").isNotNull()
    # A hash of the row, so that very many rows at one x spread over ranges too.
    spread = F.xxhash64("_row").asc()
    fwd = running(both, by, [F.col("_x").asc(), is_row.asc(), spread], {"_before": ("last", "_k")})
    back = running(fwd, by, [F.col("_x").desc(), is_row.asc(), spread], {"_after": ("last", "_k")})
    b, a = F.col("_before"), F.col("_after")
    line = b["y"] + F.try_divide(a["y"] - b["y"], a["x"] - b["x"]) * (F.col("_x") - b["x"])
    value = F.when(b.isNull(), a["y"]).when(a.isNull() | (a["x"] == b["x"]), b["y"]).otherwise(line)
    return back.filter(is_row).select("_row.*", F.when(F.col("_x").isNotNull(), value).alias(name))


def interpolate_within(
    df: DataFrame, x: str, knots: DataFrame, on: Sequence[str], kx: str, ky: str, name: str = "interpolated"
) -> DataFrame:
    """As ``interpolate`` with its own knots per key.

    Keys whose knot lists are all short (checked) carry them as an array;
    otherwise the sorted merge is used. Keys without knots give null.
    """
    on = list(on)
    k = stage(_single_knots(knots, on, kx, ky), "knots")
    most = k.groupBy(*on).count().agg(F.max("count").alias("m")).first().m or 0
    if most > CELL_KNOTS:
        return _interpolate_sorted(df, x, k, name, on)
    lists = knot_lists(k, on, "_kx", "_ky")
    return df.join(lists, on, "left").select(*df.columns, on_knot_list("_t", x).alias(name))


def knot_lists(knots: DataFrame, on: Sequence[str], kx: str, ky: str) -> DataFrame:
    """``(on..., _t)``: each key's knots as a sorted array; for keys checked to be short."""
    knot = F.struct(F.col(kx).cast("double").alias("x"), F.col(ky).cast("double").alias("y"))
    return knots.groupBy(*on).agg(F.array_sort(F.collect_list(knot)).alias("_t"))


def on_knot_list(knots: str, x: str) -> Column:
    """Linear interpolation at x on a sorted knot array, ends held flat."""
    v = F.col(x).cast("double")
    lo = F.try_element_at(F.filter(knots, lambda s: s["x"] <= v), F.lit(-1))
    hi = F.try_element_at(F.filter(knots, lambda s: s["x"] >= v), F.lit(1))
    line = lo["y"] + F.try_divide(hi["y"] - lo["y"], hi["x"] - lo["x"]) * (v - lo["x"])
    return F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == hi["x"]), lo["y"]).otherwise(line)


def splice_offset(
    obs: DataFrame, trend: DataFrame, overlap: tuple[int, int], cycle: DataFrame
) -> DataFrame:
    """One row: mean of deseasonalised observations minus the trend over the overlap years."""
    des = deseasonalise(obs, cycle).filter((F.col("x") >= overlap[0]) & (F.col("x") < overlap[1] + 1))
    at = interpolate(des, "x", trend, "x", "y", "_t")
    return at.agg(F.avg(F.col("value") - F.col("_t")).alias("offset"))


def splice(
    obs: DataFrame, trend: DataFrame, start: int, overlap: tuple[int, int], base: tuple[int, int]
) -> DataFrame:
    """Extend a monthly series back to a start year.

    Missing months are annual trend + constant offset + seasonal cycle, rounded
    to two decimals; observed months are kept verbatim. ``obs`` has year, month,
    average; ``trend`` has year and level, placed at mid-year.
    """
    # Monthly and annual rows are few; several steps below read them.
    obs, trend = stage(obs, "months"), stage(trend, "years")
    cycle = seasonal_cycle(obs, *base)
    knots = trend.select((F.col("year") + 0.5).alias("x"), F.col("level").alias("y"))
    offset = splice_offset(obs, knots, overlap, cycle)
    first = obs.agg(F.min(_month_index()).alias("_first"))
    need = (
        first.filter(F.col("_first") > start * 12)
        .select(F.explode(F.sequence(F.lit(start * 12), F.col("_first") - 1)).alias("_m"))
        .select(
            F.floor(F.col("_m") / 12).cast("int").alias("year"), (F.col("_m") % 12 + 1).cast("int").alias("month")
        )
        .withColumn("x", decimal_year("year", "month"))
    )
    back = (
        interpolate(need, "x", knots, "x", "y", "_t")
        .join(F.broadcast(cycle), "month")
        .crossJoin(F.broadcast(offset))
        .select(
            "year", "month",
            F.bround(F.col("_t") + F.col("offset") + F.col("cycle"), 2).alias("average"),
            F.lit(True).alias("reconstructed"),
        )
    )
    seen = obs.select(
        F.col("year").cast("int"), F.col("month").cast("int"), "average", F.lit(False).alias("reconstructed")
    )
    return back.unionByName(seen)


def check_series(df: DataFrame, keys: Sequence[str] = (), year: str = "year", month: str = "month") -> DataFrame:
    """One row per series: months, duplicated and missing months, first and last."""
    m = (F.col(year) * 12 + F.col(month) - 1).cast("int")
    per = df.groupBy(*keys, m.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
        (F.max("_m") - F.min("_m") + 1 - F.count(F.lit(1))).cast("bigint").alias("n_missing"),
        F.floor(F.min("_m") / 12).cast("int").alias("first_year"),
        F.floor(F.max("_m") / 12).cast("int").alias("last_year"),
    )


def missing_months(df: DataFrame, keys: Sequence[str] = (), year: str = "year", month: str = "month") -> DataFrame:
    """Months absent between a series' first and last month."""
    m = (F.col(year) * 12 + F.col(month) - 1).cast("int")
    per = df.select(*keys, m.alias("_m")).distinct()
    full = per.groupBy(*keys).agg(F.explode(F.sequence(F.min("_m"), F.max("_m"))).alias("_m"))
    return missing_keys(full, per, [*keys, "_m"]).select(
        *keys, F.floor(F.col("_m") / 12).cast("int").alias(year), (F.col("_m") % 12 + 1).cast("int").alias(month)
    )


def unsorted_rows(df: DataFrame, line: str, keys: Sequence[str] = (), year: str = "year", month: str = "month") -> DataFrame:
    """Rows whose month is not after every month on earlier lines."""
    m = (F.col(year) * 12 + F.col(month) - 1).cast("int")
    seen = running(df, keys, [line], {"_top": ("max", m)}, inclusive=False)
    return seen.filter(m < F.col("_top")).drop("_top")


def covers(df: DataFrame, first: int, last: int, keys: Sequence[str] = (), year: str = "year") -> DataFrame:
    """Whether each series reaches over a required range of years."""
    return df.groupBy(*keys).agg(
        ((F.min(year) <= first) & (F.max(year) >= last)).alias("covers")
    )
