"""Text column helpers: ids, masks, labels, digests, JSON in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# Fixed patterns of the file and id formats.
GRID_ID = r"^C(\d+)R(\d+)$"
NUMBER = r"-?\d+(\.\d+)?([eE][-+]?\d+)?"
TILE_ID = r"(h\d{2}v\d{2})"
ACQUISITION = r"\.A(\d{7})\."


def grid_column(c: Column | str) -> Column:
    """Column number of a grid id; anything but a full match is an error."""
    return _grid_part(c, 1)


def grid_row(c: Column | str) -> Column:
    """Row number of a grid id; anything but a full match is an error."""
    return _grid_part(c, 2)


def _grid_part(c: Column | str, group: int) -> Column:
    text = F.trim(as_col(c))
    return F.when(text.rlike(GRID_ID), F.regexp_extract(text, GRID_ID, group).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("bad grid id: "), text)).cast("int")
    )


def grid_id(column: Column | str, row: Column | str) -> Column:
    return F.concat(F.lit("C"), as_col(column).cast("string"), F.lit("R"), as_col(row).cast("string"))


def before_last(c: Column | str, sep: str = "__") -> Column:
    """Text before the last separator; the whole text where there is none."""
    return F.regexp_replace(as_col(c), f"^(.*){sep}.*$", "$1")


def after_last(c: Column | str, sep: str = "__") -> Column:
    return F.substring_index(as_col(c), sep, -1)


def mask_numbers(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), NUMBER, "#"))


def limits_message(low: Column | str, high: Column | str) -> Column:
    return F.concat(
        F.lit("value outside limits ["), as_col(low).cast("string"), F.lit(", "),
        as_col(high).cast("string"), F.lit("]"),
    )


def message_kind(
    method: Column | str, message: Column | str, low: Column | str, high: Column | str
) -> Column:
    """Kind of a check message: the violated limits, or the text with numbers masked."""
    breach = (as_col(method) == "checkLimits") & as_col(low).isNotNull() & as_col(high).isNotNull()
    return F.when(breach, limits_message(low, high)).otherwise(mask_numbers(message))


SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def human_bytes(c: Column | str) -> Column:
    """1024-step size with one decimal, thousands grouped."""
    x = as_col(c).cast("double")
    out = None
    for i, unit in enumerate(SIZE_UNITS):
        shown = F.concat(F.format_number(x / float(1024**i), 1), F.lit(f" {unit}"))
        test = F.abs(x) < float(1024 ** (i + 1))
        out = F.when(test, shown) if out is None else (
            out.otherwise(shown) if i == len(SIZE_UNITS) - 1 else out.when(test, shown))
    return out


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def year_token(path: Column | str) -> Column:
    """Year written before the first underscore of a file name."""
    return F.substring_index(base_name(path), "_", 1).try_cast("int")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), r"\s+", " "))


def label(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit("_"), F.lit(" "))


def tile_id(path: Column | str) -> Column:
    found = F.regexp_extract(as_col(path), TILE_ID, 1)
    return F.when(found != "", found)


def acquisition_date(path: Column | str) -> Column:
    found = F.regexp_extract(as_col(path), ACQUISITION, 1)
    return F.when(found != "", F.try_to_timestamp(found, F.lit("yyyyDDD")).cast("date"))


def list_digest(values: Column, size: int = 8) -> Column:
    """Short stable digest of a list, independent of its order."""
    return F.substring(F.sha1(F.array_join(F.array_sort(values), "\n")), 1, size)


# Labels of the climate sources (fixed values).
BASELINE_CLIMATE = "DWD"
OBSERVED_CLIMATE = "HYRAS_OBS"


def climate_group(c: Column | str) -> Column:
    x = as_col(c)
    return (
        F.when(x == BASELINE_CLIMATE, "Baseline (DWD obs.)")
        .when(x.endswith("_historical") | (x == OBSERVED_CLIMATE), "Historical")
        .otherwise("Future")
    )


def climate_order(c: Column | str) -> Column:
    """Sort key: baseline, historical (observations first), future; then the name."""
    x = as_col(c)
    rank = (
        F.when(x == BASELINE_CLIMATE, 0)
        .when(x.endswith("_historical") | (x == OBSERVED_CLIMATE), 1)
        .otherwise(2)
    )
    return F.struct(
        rank.alias("grp"), F.when(x == OBSERVED_CLIMATE, 0).otherwise(1).alias("first"), x.alias("name")
    )


# Escapes, quotes, braces and what lies between them.
_TOKENS = r"""(?s)\\.|["{}]|[^"{}\\]+|\\"""


def balanced_object(c: Column | str) -> Column:
    """What runs from a leading brace to the brace that closes it; null where none does.

    One pass over the tokens counts depth; braces inside quoted strings and escaped quotes do not count.
    """
    text = as_col(c)

    def step(seen: Column, token: Column) -> Column:
        quoted, depth = seen["quoted"], seen["depth"]
        deeper = F.when(quoted, depth).when(token == "{", depth + 1).when(token == "}", depth - 1).otherwise(depth)
        at = seen["at"] + F.length(token)
        closed = seen["end"].isNull() & ~quoted & (token == "}") & (deeper == 0)
        return F.struct(
            F.when(token == '"', ~quoted).otherwise(quoted).alias("quoted"), deeper.alias("depth"), at.alias("at"),
            F.when(closed, at).otherwise(seen["end"]).alias("end"),
        )

    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))
    end = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), start, step)["end"]
    return F.when(text.startswith("{"), F.substring(text, F.lit(1), end))


def json_in_text(c: Column | str) -> Column:
    """The JSON object inside a reply; null where none parses.

    Candidates, the first that parses as an object wins: what runs from the first opening brace to the one that closes
    it; fenced blocks come before it unless the reply itself begins with a brace.
    """
    text = F.trim(as_col(c))
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    fenced = F.transform(fenced, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    at = F.instr(text, "{")
    from_brace = F.array_compact(F.array(balanced_object(F.when(at > 0, F.substring(text, at, F.length(text))))))
    candidates = F.when(text.startswith("{"), F.concat(from_brace, fenced)).otherwise(F.concat(fenced, from_brace))
    parses = F.filter(candidates, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())
    return F.try_element_at(parses, F.lit(1))


def proposal_changes(reply: Column | str) -> Column:
    """``map<parameter, value as JSON text>`` of a proposal written in any accepted shape.

    ``{"parameter_changes": {..}}`` as is; ``{"parameter", "value"}``;
    ``{"parameter", "index", "new_value"}``; or an all-digit index map next to
    ``parameter``.
    """
    r = as_col(reply)

    def field(name: str) -> Column:
        return F.get_json_object(r, f"$.{name}")

    name = field("parameter")
    raw = field("parameter_changes")
    changes = F.from_json(raw, "map<string,string>")
    all_index = (F.size(changes) > 0) & F.forall(F.map_keys(changes), lambda k: k.rlike(r"^-*\d+$"))
    indexed = F.concat(F.lit('{"'), field("index"), F.lit('":'), field("new_value"), F.lit("}"))
    return (
        F.when(raw.isNull() & name.isNotNull() & field("value").isNotNull(), F.create_map(name, field("value")))
        .when(
            raw.isNull() & name.isNotNull() & field("index").isNotNull() & field("new_value").isNotNull(),
            F.create_map(name, indexed),
        )
        .when(raw.isNotNull() & name.isNotNull() & all_index, F.create_map(name, raw))
        .otherwise(F.coalesce(changes, F.from_json(F.lit("{}"), "map<string,string>")))
    )
