"""Date column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# Crops sown in the autumn before their harvest year (fixed values).
WINTER_CROPS = ("winter_wheat", "winter_rapeseed")


def parse_day_month_year(c: Column | str) -> Column:
    """``dd.MM.yyyy`` text to date; unreadable text -> null."""
    return F.try_to_timestamp(as_col(c), F.lit("dd.MM.yyyy")).cast("date")


def parse_year_doy(c: Column | str) -> Column:
    """``yyyyDDD`` text to date; unreadable text -> null."""
    return F.try_to_timestamp(as_col(c).cast("string"), F.lit("yyyyDDD")).cast("date")


def date_of(year: Column | str, doy: Column | str) -> Column:
    """The date of a day-of-year."""
    return F.date_add(F.make_date(as_col(year), F.lit(1), F.lit(1)), (as_col(doy) - 1).cast("int"))


def window_start(year: Column | str) -> Column:
    return F.make_date(as_col(year), F.lit(1), F.lit(1))


def window_end(year: Column | str, span: Column | int = 0) -> Column:
    extra = span if isinstance(span, Column) else F.lit(span)
    return F.make_date(as_col(year) + extra, F.lit(12), F.lit(31))


def harvest_year(
    reference_year: Column | str,
    crop: Column | str,
    phase: Column | str,
    winter: Sequence[str] = WINTER_CROPS,
    early: Sequence[str] = ("sowing", "emergence"),
) -> Column:
    """Sowing and emergence of winter crops count for the following year."""
    shift = as_col(crop).isin(*winter) & as_col(phase).isin(*early)
    return as_col(reference_year) + F.when(shift, F.lit(1)).otherwise(F.lit(0))


def decimal_year(year: Column | str, month: Column | str) -> Column:
    return as_col(year) + (as_col(month) - F.lit(0.5)) / F.lit(12.0)


def duration_seconds(c: Column | str) -> Column:
    """Seconds of ``D-HH:MM:SS``, ``D-HH:MM``, ``D-HH``, ``HH:MM:SS``, ``MM:SS`` or bare minutes."""
    text = F.trim(as_col(c))
    has_days = text.contains("-")
    days = F.when(has_days, F.substring_index(text, "-", 1).cast("int")).otherwise(F.lit(0))
    clock = F.when(has_days, F.substring_index(text, "-", -1)).otherwise(text)
    part = F.when(F.length(clock) > 0, F.split(clock, ":")).otherwise(F.array(F.lit("0")))
    n = F.size(part)

    def at(i: int) -> Column:
        return F.coalesce(F.try_element_at(part, F.lit(i)).cast("int"), F.lit(0))

    from_hours = at(1) * 3600 + at(2) * 60 + at(3)
    from_minutes = F.when(n == 3, from_hours).otherwise(at(1) * 60 + at(2))
    return days * 86400 + F.when(has_days, from_hours).otherwise(from_minutes)
