"""Consolidation of many small result files, the manifest, and other sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest_per_key
from ..session import stage
from . import manifest as M
from .catalog import RUN_FOLDER


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, header)``: the first line of every file that has one.

    Only the block at the start of a file is looked at; its lines are numbered in the order of reading.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    return lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))


def assert_same_header(spark: SparkSession, path: str, marker: str, sep: str = ";") -> list[str]:
    """The one header shared by all files; another first line is an error naming a file."""
    kinds = headers(spark, path).groupBy("header").agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("file")
    ).orderBy(F.col("n").desc(), "header").limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"header mismatch in {kinds[1].file}")
    if not kinds or not kinds[0].header.startswith(marker):
        raise ValueError(f"no header line in {path}")
    return kinds[0].header.split(sep)


def write_delimited(df: DataFrame, path: str, sep: str = ";", columns: Sequence[str] | None = None,
                    compression: str | None = None, mode: str = "error") -> None:
    """Delimited files with a fixed column order, optionally gzip."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode(mode).option("sep", sep).option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").json(path)


def consolidate(df: DataFrame, out: str, keys: Sequence[str], sort: Sequence[str], mode: str = "error") -> DataFrame:
    """Write one columnar table partitioned by experiment, locations contiguous and sorted.

    Range partitioning on (experiment, location) balances experiments of any
    size over the tasks; the commit protocol makes the table appear at once.
    With ``mode="overwrite"`` only the experiments in ``df`` are replaced.
    Returns rows and locations per experiment of the whole table.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(*keys, *sort).sortWithinPartitions(*keys, *sort)
    laid.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(out)
    written = spark.read.schema(df.schema).parquet(out)
    return written.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(sort[0]).alias("n_location_files")
    )


def stale_experiments(sources: DataFrame, manifest: DataFrame, keys: Sequence[str], modified: str = "modified", written: str = "written") -> DataFrame:
    """Experiments whose newest source is later than their manifest entry, or that have none."""
    newest = sources.groupBy(*keys).agg(F.max(modified).alias("_newest"))
    fresh = newest.join(manifest.select(*keys, F.col(written).alias("_w")), list(keys)).filter(
        F.col("_w") >= F.col("_newest")
    )
    return newest.join(fresh.select(*keys), list(keys), "left_anti").select(*keys)


def upsert_manifest(old: DataFrame, new: DataFrame, keys: Sequence[str], status: str = "status", keep: Sequence[str] = ("written", "skipped")) -> DataFrame:
    """New rows with an accepted status win over old ones; untouched rows stay; sorted by key."""
    accepted = new.filter(F.col(status).isin(*keep)).drop(status)
    both = old.withColumn("_new", F.lit(0)).unionByName(accepted.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, list(keys), ["_new"]).drop("_new").orderBy(*keys)


def deletable_logs(logs: DataFrame, manifest: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Logs of experiments in the manifest and without a failure. Nothing is deleted here."""
    return logs.join(manifest.select(*keys), list(keys), "left_semi").join(
        failed.select(*keys).distinct(), list(keys), "left_anti"
    )


def _experiment(keys: Sequence[str], layout: str, path: Column | str) -> list[Column]:
    """The keys of a file from its path, by the groups of ``layout`` in order."""
    return [F.regexp_extract(path, layout, i + 1).alias(k) for i, k in enumerate(keys)]


def _header_faults(spark: SparkSession, folders: list[str], wanted: Sequence[str], sep: str, keys: Sequence[str], layout: str) -> DataFrame:
    """``(keys, header, message)`` of each experiment: its one header, or what is wrong with its files."""
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    seen = headers(spark, folders).withColumn("file", path)
    kinds = seen.groupBy(*_experiment(keys, layout, "file")).agg(
        F.min("header").alias("header"), F.max_by("file", "header").alias("other"), F.count_distinct("header").alias("kinds")
    )
    lacking = F.array_except(F.array(*[F.lit(c) for c in wanted]), F.split("header", f"\\Q{sep}\\E"))
    message = F.when(F.col("kinds") > 1, F.concat(F.lit("header mismatch in "), F.element_at(F.split("other", "/"), -1))).when(
        F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", "))
    )
    return kinds.select(*keys, "header", message.alias("message"))


def consolidate_release(
    spark: SparkSession,
    files: DataFrame,
    root: str,
    schema: T.StructType | str,
    sort: Sequence[str],
    keys: Sequence[str] = ("crop", "exp_id"),
    layout: str = RUN_FOLDER,
    expected: DataFrame | None = None,
    sep: str = ";",
    force: bool = False,
) -> DataFrame:
    """Bring a store up to date with its source files, in one step; the status of every experiment.

    ``files`` is a catalog (``path, length, modified``) with the ``keys``; ``expected`` adds experiments that must have
    files. Status: ``written``; ``skipped``, if the number, bytes and newest time of its files are those of the manifest
    (unless ``force``); ``empty``, if expected and without files or with zero-byte files alone, which Spark does not list
    or count; ``error`` if its files do not share one
    header with all wanted columns. Only stale experiments are read. Whatever is wrong with one of them leaves the others
    alone, and its former entry stays. All rows of an experiment appear at once, with the new version of the manifest.

    Returns the keys, ``status``, ``n_location_files``, ``n_rows``, ``src_bytes``, ``out_bytes`` and ``message``. The
    names of stale experiments reach the driver, those of files do not.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [f for f in wanted.fields if f.name not in keys]
    found = files.groupBy(*keys).agg(
        F.count("*").alias("n_location_files"), F.sum("length").alias("src_bytes"), F.max("modified").alias("newest_source"),
        F.min(F.regexp_replace("path", "/[^/]*$", "")).alias("folder"),
    )
    found = found if expected is None else expected.select(*keys).distinct().join(found, list(keys), "full")
    found = stage(found.na.fill(0, ["n_location_files", "src_bytes"]), "sources")
    manifest = M.read_manifest(spark, root)
    known = found.withColumn("status", F.when(F.col("src_bytes") == 0, "empty"))
    if manifest is not None and not force:
        of = manifest.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n_location_files", "src_bytes", "newest_source")])
        same = (F.col("_n_location_files") == F.col("n_location_files")) & (F.col("_src_bytes") == F.col("src_bytes")) & (
            F.col("_newest_source") >= F.col("newest_source"))
        known = known.join(of, list(keys), "left").withColumn("status", F.coalesce("status", F.when(same, "skipped"))).select(*found.columns, "status")
    known = stage(known, "known")
    stale = known.filter("status is null")
    folders = [r.folder for r in stale.select("folder").distinct().collect()]
    nothing = spark.createDataFrame([], T.StructType([T.StructField(k, T.StringType()) for k in keys])).select(
        *keys, F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("message"))
    judged = stage(_header_faults(spark, folders, [f.name for f in fields], sep, keys, layout), "headers") if folders else nothing
    good = stale.join(judged.filter("message is null"), list(keys)).select(*keys, "header", "folder")
    # One read for each kind of header; experiments of one crop have the same.
    by_header: dict[str, list[str]] = {}
    for r in good.select("header", "folder").distinct().collect():
        by_header.setdefault(r.header, []).append(r.folder)
    token = uuid.uuid4().hex
    target = f"{root}/data/release={token}"
    types = {f.name: f.dataType for f in fields}
    rows = None
    for header, own in by_header.items():
        full = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header.split(sep)])
        part = spark.read.option("header", True).option("recursiveFileLookup", True).option("enforceSchema", False).option("sep", sep).schema(full).csv(own)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        part = part.withColumn("_file", path).select(*[f.name for f in fields], *_experiment(keys, layout, "_file"))
        rows = part if rows is None else rows.unionByName(part)
    done = nothing.select(*keys, *[F.lit(0).cast("long").alias(c) for c in ("n_rows", "out_bytes")])
    if rows is not None:
        rows.repartitionByRange(*keys, *sort).sortWithinPartitions(*keys, *sort).write.partitionBy(*keys).parquet(target)
        # Keys as they are written in the path, not as the numbers or dates that they may look like.
        names = T.StructType([*fields, *[T.StructField(k, T.StringType()) for k in keys]])
        each = spark.read.schema(names).parquet(target).groupBy(*keys, F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("n_rows"), F.max("_metadata.file_size").alias("bytes"))
        done = each.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("out_bytes"))
    out = stage(
        known.join(judged.drop("header"), list(keys), "left").join(done, list(keys), "left").withColumns({
            "status": F.coalesce("status", F.when(F.col("message").isNotNull(), "error"), F.lit("written")),
            "message": F.coalesce("message", F.lit("")), **{c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "out_bytes")},
        }), "statuses",
    )
    entries = out.filter("status = 'written'").select(
        *keys, "n_location_files", "n_rows", "src_bytes", "out_bytes", "newest_source", F.lit(token).alias("release"))
    if rows is not None:
        M.publish(spark, root, entries, keys)
    return out.select(*keys, "status", "n_location_files", "n_rows", "src_bytes", "out_bytes", "message")
