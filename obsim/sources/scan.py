"""Scans of delimited results, logs, ledgers, XML parameters and JSON grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import message_kind
from ..operators.relational import assert_not_empty
from ..operators.sampling import evenly_spaced_keys
from ..session import stage
from .catalog import file_catalog

YEARLY_FILE = r"^(\d+)_yearly\.csv$"


def _read_by_name(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, pattern: str, **options: str) -> DataFrame:
    """Delimited files whose columns are found by the names in their header; further columns may stand anywhere.

    The header of one file gives the positions; Spark compares it with the header of every file that it reads, and a
    deviating one is an error. A file without any line is skipped.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    for key, value in options.items():
        reader = reader.option(key, value)
    first = file_catalog(spark, paths, pattern).filter("length > 0").agg(F.min("path")).first()[0]
    names = reader.schema(wanted).csv(list(paths)).columns if first is None else reader.csv(first).columns
    missing = [f.name for f in wanted.fields if f.name not in names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {first}")
    types = {f.name: f.dataType for f in wanted.fields}
    full = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    return reader.schema(full).option("enforceSchema", False).csv(list(paths))


def scan_results(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    sep: str = ";",
    columns: Sequence[str] | None = None,
    sample: int | None = None,
    date_format: str = "yyyy-MM-dd",
    with_file: bool = False,
    must_exist: bool = True,
) -> DataFrame:
    """All delimited result files below a path as one table; an empty set is an error.

    ``schema`` names the wanted columns and their types, in any order and out of
    many; they are found by the header, and a file whose header deviates is an
    error. ``columns`` prunes the scan, ``sample`` reads only that many evenly
    spaced files of the sorted list, ``with_file`` adds each row's path.
    """
    wanted = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
    paths = [path] if isinstance(path, str) else list(path)
    if sample is not None:
        files = file_catalog(spark, paths, "*.csv*").select("path")
        # At most `sample` names reach the driver; only those files are opened.
        names = [r["path"] for r in evenly_spaced_keys(files, "path", sample).collect()]
        if not names:
            raise ValueError(f"no result files in {paths}")
        paths = names
    if must_exist and sample is None:
        assert_not_empty(file_catalog(spark, paths, "*.csv*"), "result files")
    df = _read_by_name(spark, paths, schema, "*.csv*", sep=sep, dateFormat=date_format)
    if with_file:
        df = df.withColumn("file", F.col("_metadata.file_path"))
    return df.select(*(columns or wanted), *(["file"] if with_file else []))


def scan_commented(spark: SparkSession, path: str, schema: T.StructType | str, comment: str = "#") -> DataFrame:
    """Comma-separated table whose comment lines are skipped; columns are found by the header."""
    names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
    return _read_by_name(spark, [path], schema, "*", comment=comment).select(*names)


def scan_weather(
    spark: SparkSession, sources: Sequence[tuple[str, str, str]], schema: T.StructType | str
) -> DataFrame:
    """Weather of several sources ``(source, folder, separator)``; gzip is read as is.

    The grid column and row come from the path, which holds ``C<col>R<row>.csv``.
    """
    out = None
    for source, folder, sep in sources:
        part = (
            _read_by_name(spark, [folder], schema, "*.csv*", sep=sep)
            .withColumn("_f", F.col("_metadata.file_path"))
            .withColumn("source", F.lit(source))
        )
        out = part if out is None else out.unionByName(part)
    cell = r"C(\d+)R(\d+)\.csv"
    return out.withColumn("vColumn", F.regexp_extract("_f", cell, 1).cast("int")).withColumn(
        "vRow", F.regexp_extract("_f", cell, 2).cast("int")
    ).drop("_f")


def scan_grid_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Rows (lat, lon, row, col) of ``[[[lat, lon], [row, col]], ...]`` documents.

    One document per line, or per file with ``whole_files`` (a small lookup file
    written over several lines).
    """
    pairs = F.from_json("value", "array<array<array<double>>>")
    return spark.read.text(path, wholetext=whole_files).select(F.explode(pairs).alias("p")).select(
        F.col("p")[0][0].alias("lat"), F.col("p")[0][1].alias("lon"),
        F.col("p")[1][0].cast("int").alias("row"), F.col("p")[1][1].cast("int").alias("col"),
    )


def scan_polygons(spark: SparkSession, path: str, properties: Sequence[str] = ("name",)) -> DataFrame:
    """Named properties (as text) and ``rings array<array<struct<x, y>>>`` of GeoJSON features, one on each line.

    All rings of a polygon or multipolygon come in one array, holes and parts alike. Features without such a geometry
    are left out.
    """
    kind, body = F.get_json_object("value", "$.geometry.type"), F.get_json_object("value", "$.geometry.coordinates")
    one = F.from_json(F.when(kind == "Polygon", body), "array<array<array<double>>>")
    many = F.flatten(F.from_json(F.when(kind == "MultiPolygon", body), "array<array<array<array<double>>>>"))
    rings = F.transform(F.coalesce(one, many), lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    names = [F.get_json_object("value", f"$.properties.{p}").alias(p) for p in properties]
    return spark.read.text(path).select(*names, rings.alias("rings")).filter("rings is not null")


def scan_params_xml(spark: SparkSession, path: str, row_tag: str = "crop", set_id: str = "_name") -> DataFrame:
    """``(set_id, param, idx, value)`` of parameter sets; a scalar has index 0."""
    value_list = T.ArrayType(T.DoubleType())
    param = T.StructType([
        T.StructField("_id", T.StringType()), T.StructField("_VALUE", T.StringType()), T.StructField("value", value_list),
    ])
    schema = T.StructType([T.StructField(set_id, T.StringType()), T.StructField("parameter", T.ArrayType(param))])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    flat = rows.select(F.col(set_id).alias("set_id"), F.explode("parameter").alias("p")).select(
        "set_id", F.col("p._id").alias("param"),
        F.when(F.size("p.value") > 0, F.col("p.value")).otherwise(
            F.array(F.trim("p._VALUE").try_cast("double"))
        ).alias("v"),
    )
    return flat.select("set_id", "param", F.posexplode("v").alias("idx", "value"))


def requested_params(wanted: DataFrame, params: DataFrame, on: Sequence[str] = ("set_id", "param")) -> DataFrame:
    """Values of requested parameters; an absent id gives a null row."""
    return wanted.join(params, list(on), "left")


LEDGER_SCHEMA = (
    "iteration int, status string, objective double, parameters_changed map<string,string>, "
    "improved boolean, accepted boolean, reason string, elapsed_seconds double"
)


def scan_ledger(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """Ledger records, one JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


# Columns of the log where its header does not name them (fixed values).
CHECK_COLUMNS = {"CheckMethod": 0, "VariableName": 4, "AdditionalInformation": 5}


# Headers of about 100 bytes that are sent to every task.
MOST_HEADERS = 200_000


def scan_check_log(spark: SparkSession, path: str) -> DataFrame:
    """Check messages of logs with a banner line and a tab-separated table.

    Returns file, method, variable and kind. Positions come from each file's
    header, falling back to the usual ones; shorter rows are skipped. Files are
    split by blocks: the header of a file is found by its content in the first
    one, so no file has to be read by one task, and lines are not exchanged.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", -1)
    rows = lines.select("file", "_block", parts.alias("f"))
    is_header = F.array_contains("f", "CheckMethod") & F.array_contains("f", "VariableName") & F.array_contains(
        "f", "AdditionalInformation"
    )
    # Header lines alone, from the first block of each file: one short row per file, sent to every task if they are few.
    first = rows.filter(is_header & (F.col("_block") == 0))
    where = stage(first.groupBy("file").agg(*[
        F.max(F.array_position("f", name).cast("int") - 1).alias(f"_{name}") for name in CHECK_COLUMNS
    ]), "log-headers")
    where = F.broadcast(where) if where.count() <= MOST_HEADERS else where
    at = rows.join(where, "file", "left").fillna({f"_{name}": i for name, i in CHECK_COLUMNS.items()})
    msg = F.col("_AdditionalInformation")

    def field(i: Column) -> Column:
        return F.try_element_at("f", i + 1)

    body = at.filter(~is_header & (F.size("f") > msg))
    low = F.when(F.size("f") > msg + 2, field(msg + 1))
    high = F.when(F.size("f") > msg + 2, field(msg + 2))
    method, variable = field(F.col("_CheckMethod")), field(F.col("_VariableName"))
    return body.select(
        "file", method.alias("method"), variable.alias("variable"),
        message_kind(method, field(msg), low, high).alias("kind"),
    )
