"""Exact dedup by a tree-merge of sorted digest runs.

Every partition sorts its rows by digest and folds equal digests into one entry: the entry's winner and its number of
rows. Runs then meet in rounds. Partitions are numbered in base ``fan``; in a round the partitions whose numbers differ
in one digit alone exchange slices of their runs, each keeping the digests whose slice has its digit (several binomial
rounds at once, ``fan`` runs merged instead of two). After one round for each digit, every partition holds one range of
digests merged over all rows. A digest however frequent is one entry of each run from the start, and no task ever
gets more than its range of the entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A

# Most runs merged at once, and rows for which a partition of the tree is meant.
FAN = 16
RUN_ROWS = 2_000_000
_ENTRY = ("digest", "n_bytes", "id", "row", "size")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries to one entry for each digest: the first of equal ones, with the sum of their sizes.

    Entries are equal if digest and length are. The last entry of a batch waits for the next one.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        digest, length = batch.column("digest"), batch.column("n_bytes")
        differs = pc.or_(pc.not_equal(digest[1:], digest[:-1]), pc.not_equal(length[1:], length[:-1]))
        starts = np.concatenate([[0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1])
        sizes = np.add.reduceat(batch.column("size").to_numpy(), starts)
        first = batch.take(pa.array(starts))
        # The schema of the batch, for batches of a stream must agree down to nullability.
        columns = [pa.array(sizes) if c == "size" else first.column(c) for c in batch.schema.names]
        merged = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        held = merged.slice(len(starts) - 1)
        if len(starts) > 1:
            yield merged.slice(0, len(starts) - 1)
    if held is not None:
        yield held


def tree(rows: int, at_least: int, fan: int = FAN, run_rows: int = RUN_ROWS) -> tuple[int, int]:
    """``(fan, rounds)``: ``fan ** rounds`` partitions, enough for the rows and as even as the rounds allow."""
    wanted = max(at_least, math.ceil(rows / run_rows), 2)
    rounds = next(r for r in range(1, 64) if fan**r >= wanted)
    return next(f for f in range(2, fan + 1) if f**rounds >= wanted), rounds


def merged_runs(entries: DataFrame, fan: int, rounds: int) -> DataFrame:
    """One entry for each digest of ``(digest, n_bytes, id, row, size)``: that of the largest id, and the summed size.

    Null ids are smaller than all others; of equal ids the largest row number wins.
    """
    parts = fan**rounds
    # The slice of a digest: its place among `parts` even ranges, by its first four bytes.
    lead = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    part = F.shiftrightunsigned(lead * parts, 32)
    order = ("slot", "digest", "n_bytes", F.desc_nulls_last("id"), F.desc("row"))
    schema = ", ".join(f"{f} {entries.schema[f].dataType.simpleString()}" for f in _ENTRY) + ", slot int"
    runs = entries.select(*_ENTRY, F.pmod(F.spark_partition_id(), F.lit(parts)).alias("slot"))
    runs = runs.sortWithinPartitions(*order).mapInArrow(fold, schema)
    for k in reversed(range(rounds)):
        unit = fan**k
        own, wanted = F.floor(F.col("slot") / unit) % fan, F.floor(part / unit) % fan
        runs = (
            runs.withColumn("slot", (F.col("slot") + (wanted - own) * unit).cast("int"))
            .repartitionById(parts, "slot").sortWithinPartitions(*order).mapInArrow(fold, schema)
        )
    return runs.drop("slot")


def digest_of(text: Column) -> tuple[Column, Column]:
    """SHA-256 and length of a text's UTF-8 bytes; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(body, 256)), F.octet_length(body).cast("long")


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
                fan: int = FAN, run_rows: int = RUN_ROWS) -> DataFrame:
    """Columns ``carry`` (default: all) and ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    Rows are equal if their texts are, byte for byte, without any normalisation; a null text is empty. The row with the
    largest id is ``kept``, and ``keep_id`` is its id. A null id is smaller than any; of rows with equal text and id just
    one is kept, whichever has the larger row number of this run. Equality is verified on the whole SHA-256 and the
    length in every round. Texts of any length are read as a whole and never leave their task unless carried. Carried
    columns named like a result are replaced; an empty table gives an empty result.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in results]
    digest, length = digest_of(F.col(f"`{text}`"))
    n = A.own_names(docs, *_ENTRY, "winner", "of", "bytes")
    named = stage(docs.select(
        *[f"`{c}`" for c in kept], digest.alias(n["digest"]), length.alias(n["n_bytes"]), F.col(f"`{doc_id}`").alias(n["id"]),
        F.monotonically_increasing_id().alias(n["row"]),
    ), "digests")
    spark = docs.sparkSession
    fan, rounds = tree(named.count(), int(spark.conf.get("spark.sql.shuffle.partitions")), fan, run_rows)
    entries = named.select(*[F.col(n[c]).alias(c) for c in _ENTRY[:-1]], F.lit(1).cast("long").alias("size"))
    winners = merged_runs(entries, fan, rounds).select(
        F.col("digest").alias(n["of"]), F.col("n_bytes").alias(n["bytes"]), F.col("id").alias("keep_id"),
        F.col("row").alias(n["winner"]), F.col("size").alias("group_size"),
    )
    joined = named.join(winners, (F.col(n["digest"]) == F.col(n["of"])) & (F.col(n["n_bytes"]) == F.col(n["bytes"])))
    return joined.select(
        *[f"`{c}`" for c in kept], "keep_id", "group_size", (F.col(n["row"]) == F.col(n["winner"])).alias("kept"),
        F.lower(F.hex(n["digest"])).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: of equal texts the one with the largest id (see ``mark_copies``)."""
    tag = A.own_names(docs, "packed")["packed"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(tag), F.col(f"`{text}`").alias("text"),
                         F.col(f"`{doc_id}`").alias("doc_id"))
    return mark_copies(packed, carry=[tag], **settings).filter("kept").select(f"{tag}.*")
