"""Incremental consolidation of arriving result files, and which experiments are complete."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import latest_per_key


def consolidate_stream(
    spark: SparkSession,
    src: str,
    out: str,
    schema: T.StructType | str,
    checkpoint: str,
    keys: Sequence[str] = (),
    sep: str = ";",
    max_files: int = 100_000,
) -> StreamingQuery:
    """Take in every file that arrived since the last call, then stop.

    The file source remembers what it has read in the checkpoint, so a file is
    consolidated once. A file whose header deviates from the schema is an error. Each batch replaces its own ``batch_id`` partition; a
    batch retried after a failure therefore cannot double its rows.
    """
    source = (
        spark.readStream.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", False)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).csv(src)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        laid = batch.sortWithinPartitions(*keys) if keys else batch
        laid.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(write).start()
    )


def read_consolidated(spark: SparkSession, out: str, schema: T.StructType | str) -> DataFrame:
    """The consolidated table with its batch number."""
    parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*parsed.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(full).parquet(out)


def batch_manifest(consolidated: DataFrame, keys: Sequence[str], location: str) -> DataFrame:
    """Rows and locations per experiment and batch."""
    return consolidated.groupBy(*keys, "batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(location).alias("n_locations")
    )


_STATUS = "experiment string, seen long, expected long, status string"


def _arrived(wait_ms: int):
    """State of an experiment: files seen and expected. Each batch with new files sets the timer anew."""

    def update(key: tuple, files: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, expected = state.get if state.exists else (0, 0)
        late = state.hasTimedOut
        if not late:
            for part in files:
                seen, expected = seen + len(part), int(part.expected.max())
        done = seen >= expected
        state.update((seen, expected))
        if not (done or late):
            state.setTimeoutDuration(wait_ms)
        status = "complete" if done else "incomplete" if late else "waiting"
        yield pd.DataFrame({"experiment": [key[0]], "seen": [seen], "expected": [expected], "status": [status]})

    return update


def watch_arrivals(
    spark: SparkSession, src: str, experiment: str, expected: DataFrame, out: str, checkpoint: str, wait_ms: int, pattern: str = "*.csv",
) -> StreamingQuery:
    """Report which experiments have all their files, for what arrived since the last call.

    ``experiment`` is a pattern whose first group is an experiment in a file's path; ``expected(experiment, expected)``
    has the number of its files. An experiment is ``waiting``, ``complete``, or ``incomplete`` once no further file came
    within ``wait_ms``, which the next call after that time with any new file reports; files that come later count on. Files are listed,
    not read; each is counted once, as the file source remembers it. Two numbers for each experiment are kept as state.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "recursiveFileLookup", True).option("pathGlobFilter", pattern).load(src)
    named = files.select(F.regexp_extract("path", experiment, 1).alias("experiment")).join(expected.select("experiment", "expected"), "experiment")
    status = named.groupBy("experiment").applyInPandasWithState(
        _arrived(wait_ms), _STATUS, "seen long, expected long", "update", GroupStateTimeout.ProcessingTimeTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # One batch a call: with timers, "available now" would go on for as long as any is set.
    return status.writeStream.outputMode("update").trigger(once=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def arrival_status(spark: SparkSession, out: str) -> DataFrame:
    """The last reported status of every experiment."""
    reports = spark.read.schema(f"{_STATUS}, batch_id long").parquet(out)
    return latest_per_key(reports, ["experiment"], ["batch_id"]).drop("batch_id")
