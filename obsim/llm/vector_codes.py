"""Vector code compression by member-resident Lloyd iterations (a product quantiser over whole numbers).

Vectors become whole numbers and are cut into parts; each part position has a codebook of its own. Parts live with the
codebook entry they are assigned to: rows are partitioned by (position, entry, salt), and an entry that owns many rows
is salted over several owners. In a round the owners add up their resident members, the sums (as many rows as
entries) become the new codebook, parts are assigned anew where they are, and only those whose entry changed migrate to
their new owner in the next shuffle; the rest is read again from where it was written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Whole numbers up to this size keep squared distances of parts of up to 500 components exact.
LARGEST = 1 << 26
# Up to this size a product of parts is exact in double precision, too.
_EXACT_DOUBLE = 1 << 22
_ROWS = 4_096


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; the result is an error where it exceeds ``LARGEST``."""

    def one(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double")) * scale <= LARGEST, value).otherwise(
            F.raise_error(F.lit(f"a vector component times {scale} exceeds {LARGEST}")).cast("long")
        )

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """True for a vector that is neither null nor empty and has finite components alone."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest entry of ``book`` for each row (ties: the lowest) and its squared distance, exactly."""
    if max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)) <= _EXACT_DOUBLE and rows.shape[1] <= 128:
        x, c = rows.astype(np.float64), book.astype(np.float64)
        best = np.argmin((c * c).sum(axis=1) - 2.0 * (x @ c.T), axis=1)
    else:
        best = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 64):
            best[at:at + 64] = np.argmin(((rows[at:at + 64, None, :] - book[None]) ** 2).sum(axis=2), axis=1)
    return best, ((rows - book[best]) ** 2).sum(axis=1)


def assigner(books: list[np.ndarray]):
    """Arrow batches ``(row, position, entry, part)`` with ``next`` and ``distance`` added: the nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                position = batch.column("position").to_numpy(zero_copy_only=False)
                part = batch.column("part")
                values = part.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                chosen, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
                for k in np.unique(position):
                    own = np.flatnonzero(position == k)
                    chosen[own], distance[own] = nearest(values[own], books[k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("position"), batch.column("entry"), part, pa.array(chosen), pa.array(distance)],
                    ["row", "position", "entry", "part", "next", "distance"],
                )

    return run


_ASSIGNED = "row long, position int, entry int, part array<long>, next int, distance long"


def assign(parts: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    return stage(parts.select("row", "position", "entry", "part").mapInArrow(assigner(books), _ASSIGNED), label)


def migrated(assigned: DataFrame) -> DataFrame:
    """Parts with their new owner: residents stay in the files they are in, the others are shuffled and written.

    An entry with more rows than a partition is meant to hold is salted over as many owners as that takes. Their list
    has one row for each entry, which the parameters bound.
    """
    stay = assigned.filter("entry = next").select("row", "position", "entry", "part")
    movers = assigned.filter("entry is null or entry <> next")
    counts = [tuple(r) for r in movers.groupBy("position", "next").count().collect()]
    if not counts:
        return stay
    spark = assigned.sparkSession
    fair = sum(c for _, _, c in counts) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = spark.createDataFrame([(p, e, math.ceil(c / fair)) for p, e, c in counts], "position int, next int, owners long")
    sent = (
        movers.join(F.broadcast(owners), ["position", "next"])
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.col("owners")))
        .repartition("position", "next", "salt")
        .select("row", "position", F.col("next").alias("entry"), "part")
    )
    return stay.unionByName(stage(sent, "vector-moved"))


def updated(residents: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """New codebooks from the owners' sums: ``floor(sum / count)`` of an entry's members; entries without any stay.

    Owners hold few entries each, so little more than one row for each entry is shuffled and reaches the driver.
    """
    width = books[0].shape[1]
    sums = residents.groupBy("position", "entry").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.get("part", F.lit(k))) for k in range(width)]).alias("sums")
    )
    new = [b.copy() for b in books]
    for r in sums.collect():
        new[r.position][r.entry] = [s // r.n for s in r.sums]
    return new


def compress(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(codes, codebooks)``. Codes: ``vec_id, label, code array<int>, error long`` for every usable vector.

    Vectors that are null, empty or hold null or non-finite components are dropped; so are those that can't be cut into
    ``parts`` equal parts, and vectors of another length than the smallest id's, which have no place in its codebooks. A
    component that times ``scale`` exceeds ``LARGEST`` is an error. Codebooks start from the vectors of the ``entries``
    smallest ids (fewer, if there are fewer). A null id is larger than any; rows with equal ids are ordered by their
    components and all coded. Null labels are labels. Without a usable vector, there are no codes and no codebooks.
    """
    fits = usable(F.col(f"`{vector}`")) & (F.size(F.col(f"`{vector}`")) % parts == 0)
    base = stage(vectors.filter(fits).select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), whole_numbers(F.col(f"`{vector}`"), scale).alias("whole"),
        F.monotonically_increasing_id().alias("row"),
    ), "vectors")
    # As many rows as a codebook has entries reach the driver.
    order = (F.asc_nulls_last("vec_id"), "whole")
    first = base.orderBy(*order).select(F.size("whole")).limit(1).collect()
    dim = first[0][0] if first else 0
    if not dim:
        return base.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), []
    whole = base.filter(F.size("whole") == dim)
    seeds = np.array([r[0] for r in whole.orderBy(*order).limit(entries).select("whole").collect()], np.int64)
    width = dim // parts
    books = [seeds[:, k * width:(k + 1) * width] for k in range(parts)]
    cut = F.array(*[F.struct(F.lit(k).alias("position"), F.slice("whole", k * width + 1, width).alias("part")) for k in range(parts)])
    loose = whole.select("row", F.explode(cut).alias("x")).select("row", "x.position", F.lit(None).cast("int").alias("entry"), "x.part")
    assigned = assign(loose, books, "vector-parts")
    for _ in range(rounds):
        residents = migrated(assigned)
        books = updated(residents, books)
        assigned = assign(residents, books, "vector-parts")
    coded = assigned.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("position", "next"))).alias("code"), F.sum("distance").alias("error")
    )
    codes = base.select("row", "vec_id", "label").join(coded, "row")
    return codes.select("vec_id", "label", F.col("code.next").alias("code"), "error"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and place, joined with commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors summed over equal labels, nulls together."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def reconstructed(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector array<double>``: the middle of what the codes stand for, at the scale of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(books))
            values = np.hstack([b[code[:, k]] for k, b in enumerate(books)]) if books else np.zeros((batch.num_rows, 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list((values + 0.5) / scale), pa.list_(pa.float64()))], [*batch.schema.names, "vector"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{fields}, vector array<double>")
