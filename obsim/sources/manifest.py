"""A versioned manifest beside consolidated data.

Layout of a store: ``data/release=<token>/<keys>/`` holds what one run has written, ``manifest/<token>/`` a snapshot of the
whole manifest (one row for each experiment, which names the release that holds it), and ``versions/<number>`` a pointer
to a snapshot. A version becomes visible when its pointer is renamed into place, which fails if another run took the
number first. So readers see the former or the new version and nothing between, and what an interrupted run leaves
behind belongs to no version.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest_per_key
from ..session import stage

ATTEMPTS = 20


class LostRace(RuntimeError):
    """Another run has created the version first."""


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and snapshot of the newest version; ``(0, None)`` before the first."""
    where, files = _folder(spark, f"{root}/versions")
    if not files.util().exists(where):
        return 0, None
    names = [s.getPath().getName() for s in files.util().listStatus(where)]
    last = max((n for n in names if re.fullmatch(r"\d{10}", n)), default=None)
    if last is None:
        return 0, None
    return int(last), spark.read.text(f"{root}/versions/{last}").first()[0]


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The manifest of a version (default: the newest); None before the first."""
    number, snapshot = latest(spark, root)
    if version is not None and version != number:
        snapshot = spark.read.text(f"{root}/versions/{version:010d}").first()[0]
    return None if snapshot is None else spark.read.parquet(f"{root}/manifest/{snapshot}")


def create_version(spark: SparkSession, root: str, number: int, snapshot: str) -> None:
    """Point version ``number`` to a snapshot; ``LostRace`` if it exists."""
    jvm = spark._jvm
    where, files = _folder(spark, f"{root}/versions")
    files.mkdir(where, None, True)
    draft = jvm.org.apache.hadoop.fs.Path(where, f"_draft-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(draft, flags, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(snapshot.encode()))
    out.close()
    rename = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: never overwrite
    try:
        files.rename(draft, jvm.org.apache.hadoop.fs.Path(where, f"{number:010d}"), rename)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise LostRace(f"version {number} exists") from error
        raise


def publish(spark: SparkSession, root: str, rows: DataFrame, keys: Sequence[str], newest: str = "newest_source", attempts: int = ATTEMPTS) -> int:
    """Upsert ``rows`` into the manifest as a new version; its number.

    Where another run was faster, the upsert is repeated on its version. Of two entries for one experiment the one from
    the newer source stays, of equally new ones ours.
    """
    rows = stage(rows, "manifest-rows")
    for _ in range(attempts):
        number, snapshot = latest(spark, root)
        new = rows.withColumn("_new", F.lit(1))
        if snapshot is not None:
            new = spark.read.parquet(f"{root}/manifest/{snapshot}").withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        token = uuid.uuid4().hex
        # As many rows as experiments: one sorted file.
        latest_per_key(new, list(keys), [newest, "_new"]).drop("_new").coalesce(1).sortWithinPartitions(*keys).write.parquet(f"{root}/manifest/{token}")
        try:
            create_version(spark, root, number + 1, token)
            return number + 1
        except LostRace:
            continue
    raise LostRace(f"no free version in {attempts} attempts")


def read_data(spark: SparkSession, root: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The rows that a version names: of every experiment those of its own release. Other releases are not listed."""
    manifest = read_manifest(spark, root, version)
    if manifest is None:
        raise ValueError(f"no version in {root}")
    named = manifest.select("release", *keys)
    # Names of releases alone reach the driver.
    folders = [f"{root}/data/release={r.release}" for r in named.select("release").distinct().collect()]
    reader = spark.read.option("basePath", f"{root}/data")
    # Keys as they are written in the path, not as the numbers or dates that they may look like.
    types = [T.StructField(f.name, T.StringType()) if f.name in keys else f for f in reader.parquet(*folders).schema]
    return reader.schema(T.StructType(types)).parquet(*folders).join(named, ["release", *keys], "left_semi").drop("release")
