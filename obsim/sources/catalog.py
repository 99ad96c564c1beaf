"""File and run catalogs from file metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import after_last, base_name, before_last


# Crop, experiment and namespace in the path of a result file; the same as partition folders.
RUN_FOLDER = r"/([^/]+)/runs/([^/]+)/out/([^/]+)/yearly/([^/]+)$"
RUN_PARTITIONS = r"/crop=([^/]+)/exp_id=([^/]+)/namespace=([^/]+)/([^/]+)$"


def file_catalog(spark: SparkSession, root: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """path, name, length and modification time of files below a root; contents are not read."""
    paths = [root] if isinstance(root, str) else list(root)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    )
    return files.select("path", base_name("path").alias("name"), "length", F.col("modificationTime").alias("modified"))


def yearly_files(catalog: DataFrame, pattern: str = r"^(\d+)_yearly\.csv$") -> DataFrame:
    """Files named by their location, with its number."""
    return catalog.filter(F.col("name").rlike(pattern)).withColumn(
        "location", F.regexp_extract("name", pattern, 1).cast("bigint")
    )


def runs(catalog: DataFrame, crops: Sequence[str] = (), climates: Sequence[str] = (), soils: Sequence[str] = (),
         layout: str = RUN_FOLDER) -> DataFrame:
    """Experiment files ``<crop>/runs/<exp>/out/<namespace>/yearly/<file>`` or of another layout, own namespace only."""

    def part(i: int) -> Column:
        return F.regexp_extract("path", layout, i)

    out = catalog.filter(F.col("path").rlike(layout)).select(
        "*", part(1).alias("crop"), part(2).alias("exp_id"), part(3).alias("namespace")
    ).filter(F.col("exp_id") == F.col("namespace")).drop("namespace")
    out = out.withColumn("climate", before_last("exp_id")).withColumn("soil", after_last("exp_id"))
    for name, wanted in (("crop", crops), ("climate", climates), ("soil", soils)):
        if wanted:
            out = out.filter(F.col(name).isin(*wanted))
    return out


def latest_run(catalog: DataFrame, variables: DataFrame, label: str = "label", modified: str = "modified") -> DataFrame:
    """Per variable its own run if one exists, else the newest run.

    ``variables(variable, own)`` names each variable's own run label; labels of
    calibration runs (``optim:``) are never the fallback. A tie on time goes to
    the larger label.
    """
    seen = catalog.groupBy(label).agg(F.max(modified).alias("_m"))
    newest = seen.filter(~F.col(label).startswith("optim:")).agg(
        F.max(F.struct("_m", F.col(label).alias("l"))).alias("_n")
    )
    own = variables.join(seen.select(F.col(label).alias("own"), F.lit(True).alias("_has")), "own", "left")
    return own.crossJoin(F.broadcast(newest)).select(
        "variable", F.when(F.col("_has"), F.col("own")).otherwise(F.col("_n.l")).alias("run")
    )
