"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal bytes. Its i-th block (from 0) is released at slot floor(i / w) and due
at slot ceil((i + 1) / w), w being its target weight; of the released blocks the one with the earliest deadline takes the
slot. Each source then has, after any number of slots, less than one block more or less than its weight demands.

Weights are whole numbers of about 1e-15, so releases and deadlines are exact. The schedule is made in frames that do not
wait for each other. What earliest-deadline-first has done by a slot depends on the releases of the last 1 / w slots alone, w
being the smallest weight: every block released before has its deadline in the past, whatever order they were taken in. So
a frame starts that many slots early, from any rounding of the weights that sums to the slot, and has the schedule's
own state when its part begins. Built-in expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A

BLOCK_BYTES = 8_192
# Slots of a frame at least; it is never shorter than the run-up before it, so the run-up at most doubles the work.
FRAME = 4_096
# Slots that one fold appends to before they are set aside.
CHUNK = 512
# Target weights follow the sources' bytes to this power: large sources give way a little to small ones.
TEMPER = 0.9
# Bytes of a source that are numbered together; a source has as many such pieces as its size asks for.
PIECE_BYTES = 4 << 20
_SEED = 8_117
_UNIT = 1 << 40
_PARTS = 10**15
# A waiting block is one number: its deadline from the frame's start, then its source's number.
_SOURCES = 1 << 24
_FAR = 1 << 38


def tempered_weights(sizes: DataFrame, temper: float = TEMPER) -> DataFrame:
    """``(source, weight)`` from ``(source, bytes)``: the bytes to the power ``temper``, not yet normalised."""
    return sizes.select("source", F.pow(F.col("bytes").cast("double"), F.lit(temper)).alias("weight"))


def whole_weights(weights: DataFrame) -> DataFrame:
    """``(source, number, parts)``: the weights as whole numbers of about 1e-15, sources numbered by name from 0.

    The list of sources is short beside the documents; one task orders it.
    """
    everything = Window.partitionBy(F.lit(1))
    parts = F.round(F.col("weight") / F.sum("weight").over(everything) * _PARTS)
    return weights.select(
        "source", (F.row_number().over(everything.orderBy("source")) - 1).cast("long").alias("number"),
        F.greatest(parts, F.lit(1)).cast("long").alias("parts"),
    )


def _product(a: Column | int, b: Column | int) -> Column:
    """a * b without overflow, for a below 1e19 and b below 1e18."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    return a.cast("decimal(19,0)") * b.cast("decimal(18,0)")


def _floor_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, (b if isinstance(b, Column) else F.lit(b).cast("long")).cast("decimal(19,0)"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def schedule(plan: DataFrame, slots: int, frame: int = FRAME) -> DataFrame:
    """``(source, block, slot)`` of slots 0 to ``slots`` - 1, from ``(source, number, parts)``.

    Earliest deadline first; among equal deadlines the source with the smaller number. Every slot is taken, for the
    weights fill them. A frame is one row that holds its slots' releases: as many as the smallest weight's blocks lie
    apart, or ``frame`` if that is more.
    """
    facts = plan.agg(F.sum("parts").alias("total"), F.min("parts").alias("least")).first()
    if facts["total"] is None or slots == 0:
        return plan.select("source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot")).limit(0)
    total, parts = facts["total"], F.col("parts")
    runup = total // facts["least"] + 3
    length = min(max(frame, runup), slots)
    start, end = F.col("start"), F.col("end")

    def due(block: Column) -> Column:
        return _floor_div(_product(block + 1, total) + parts.cast("decimal(19,0)") - 1, parts)

    frames = plan.select("number", "parts", F.explode(F.sequence(F.lit(0), F.lit((slots - 1) // length))).alias("frame")).withColumns({
        "start": F.greatest(F.col("frame").cast("long") * length - runup, F.lit(0)),
        "end": F.least((F.col("frame").cast("long") + 1) * length, F.lit(slots)),
    })
    # The rounding a frame starts from: whole blocks, and as many begun ones as slots are left, earliest deadlines first.
    begun = frames.withColumn("low", _floor_div(_product(start, parts), total))
    begun = begun.withColumn("part", _product(start, parts) > _product(F.col("low"), total)).withColumn("low_due", due(F.col("low")))
    own = Window.partitionBy("frame")
    left = start - F.sum("low").over(own)
    place = F.row_number().over(own.orderBy(F.desc("part"), "low_due", "number"))
    begun = begun.withColumn("first", F.col("low") + F.when(place <= left, 1).otherwise(0))
    last = _floor_div(_product(end, parts) + F.lit(total - 1).cast("decimal(19,0)"), total) - 1
    released = begun.withColumn("last", last).filter(F.col("first") <= F.col("last")).select(
        "frame", "start", "number", "parts", F.explode(F.sequence("first", "last")).alias("block")
    )
    coded = released.select(
        "frame", F.greatest(_floor_div(_product(F.col("block"), total), parts), start).alias("slot"),
        (F.least(due(F.col("block")) - start, F.lit(_FAR)) * _SOURCES + F.col("number")).alias("code"),
    )
    every_slot = frames.select("frame", "start", "end").distinct().select(
        "frame", F.explode(F.sequence(start, end - 1)).alias("slot"), F.lit(None).cast("long").alias("code")
    )
    listed = coded.unionByName(every_slot).groupBy("frame", "slot").agg(F.collect_list("code").alias("codes"))
    rows = listed.groupBy("frame").agg(F.min("slot").alias("start"), F.array_sort(F.collect_list(F.struct("slot", "codes"))).alias("slots"))

    def take(state: Column, at: Column) -> Column:
        return _let(F.concat(state["waiting"], at["codes"]), lambda waiting: _let(F.array_min(waiting), lambda code: F.struct(
            F.coalesce(F.array_remove(waiting, code), waiting).alias("waiting"),
            F.concat(state["order"], F.array(code)).alias("order"),
        )))

    def take_chunk(state: Column, chunk: Column) -> Column:
        at = F.struct(state["waiting"].alias("waiting"), F.array().cast("array<long>").alias("order"))
        return _let(F.aggregate(F.slice(F.col("slots"), chunk * CHUNK + 1, F.lit(CHUNK)), at, take), lambda done: F.struct(
            done["waiting"].alias("waiting"), F.concat(state["orders"], F.array(done["order"])).alias("orders")
        ))

    chunks = F.sequence(F.lit(0), F.floor((F.size("slots") - 1) / CHUNK).cast("int"))
    empty = F.struct(F.array().cast("array<long>").alias("waiting"), F.array().cast("array<array<long>>").alias("orders"))
    order = rows.select("frame", "start", F.flatten(F.aggregate(chunks, empty, take_chunk)["orders"]).alias("order"))
    taken = order.select("frame", "start", F.posexplode("order").alias("place", "code")).select(
        (start + F.col("place")).alias("slot"), (F.col("code") % _SOURCES).alias("taker"), F.floor(F.col("code") / _SOURCES).alias("wait"),
        "start", "frame",
    ).filter(F.col("slot") >= F.col("frame").cast("long") * length)
    # A deadline names its block: floor(due * w) - 1. One that is further off than the code holds is a first block's.
    block = F.when(F.col("wait") == _FAR, 0).otherwise(_floor_div(_product(F.col("wait") + start, parts), total) - 1)
    return taken.join(plan, F.col("taker") == F.col("number")).select("source", block.cast("long").alias("block"), "slot")


def pieces_of(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
              piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, str]]:
    """``(rows, offsets, sizes, names)``: rows with their piece and the bytes before them in it, bytes of a source before each
    of its pieces, and the bytes of each source.

    Documents of a source follow a hash of their id. A source is numbered in pieces of about ``piece_bytes`` bytes, so
    a hot source takes as many tasks as its size asks for; only one total for each piece is summed up in order. Pieces of all
    sources have one number without nulls, so that a join on it goes on where the rows were dealt out for numbering.
    """
    n = A.own_names(docs, "source", "bytes", "draw", "piece", "before", "of", "count", "from", "low")
    text_bytes = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1
    keyed = docs.withColumns({
        n["source"]: F.col(f"`{source}`").cast("string"),
        n["bytes"]: text_bytes,
        n["draw"]: F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`")), F.lit(_SEED)), F.lit(_UNIT)),
    })
    narrow = stage(keyed.select(F.col(n["source"]).alias("source"), F.col(n["bytes"]).alias("bytes"), F.col(n["draw"]).alias("draw")), "mix-rows")
    sizes = stage(narrow.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "mix-sizes")
    # The list of sources is short beside the documents; one task numbers their pieces.
    in_order = Window.partitionBy(F.lit(1)).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    counts = sizes.select("source", F.ceil(F.col("bytes") / piece_bytes).alias("count"))
    counts = stage(counts.select("source", "count", F.coalesce(F.sum("count").over(in_order), F.lit(0)).alias("from")), "mix-pieces")

    def piece_of(draw: Column, count: Column, start: Column) -> Column:
        return start + F.floor(draw * count / F.lit(_UNIT)).cast("long")

    totals = (
        narrow.join(counts, narrow["source"].eqNullSafe(counts["source"]))
        .select(narrow["source"], "bytes", piece_of(F.col("draw"), F.col("count"), F.col("from")).alias("piece"))
        .groupBy("source", "piece").agg(F.sum("bytes").alias("bytes"))
    )
    upto = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(totals.select("source", "piece", "bytes", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("before")), "mix-offsets")
    c = counts.withColumnsRenamed({"source": n["of"], "count": n["count"], "from": n["from"]})
    placed = keyed.join(c, keyed[n["source"]].eqNullSafe(c[n["of"]])).withColumn(
        n["piece"], piece_of(F.col(n["draw"]), F.col(n["count"]), F.col(n["from"]))
    ).drop(n["of"], n["count"], n["from"])
    inside = Window.partitionBy(n["piece"]).orderBy(n["draw"], F.col(f"`{doc_id}`")).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(n["before"], F.coalesce(F.sum(n["bytes"]).over(inside), F.lit(0))), offsets, sizes, n


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id",
        block_bytes: int = BLOCK_BYTES, frame: int = FRAME, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Add ``mix_block`` (long, of the source), ``mix_slot`` (long) and ``in_mix`` (boolean).

    ``weights``: ``(source, weight)``, positive, one for every source (a missing one is an error; sources without rows
    do not count); by default the tempered bytes. Reading rows by slot gives every source its weight to within less than
    one block at every place, until the source has no block left; its turns then stay empty, and the others keep theirs.
    Rows before the first empty turn can come are ``in_mix``.
    A block is a range of bytes of the source's own order; a document belongs to the block in which it starts, so blocks
    that a very long document covers may have no row.

    Every row comes back once with the columns of ``docs`` (earlier columns of the three names are replaced). A null
    source is a source of its own; null and empty texts count one byte, so that they have a place; null and repeated
    ids are ordinary rows. An empty table gives an empty result. The schedule has as many slots as the source that
    lasts longest asks for, whatever the number of sources.
    """
    placed, offsets, sizes, n = pieces_of(docs, source, text, doc_id, piece_bytes)
    targets = (tempered_weights(sizes) if weights is None else weights).withColumnRenamed("source", "of")
    known = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    if not known.filter(F.col("weight").isNull() | ~(F.col("weight") > 0)).isEmpty():
        raise ValueError("a source without a positive weight")
    counts = sizes.select(F.col("source").alias("of"), F.ceil(F.col("bytes") / block_bytes).cast("long").alias("blocks"))
    plan = stage(whole_weights(known).join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mix-plan")
    total = plan.agg(F.sum("parts")).first()[0] or 0
    # A source's turn after its last block is not released before this slot.
    out = _floor_div(_product(F.col("blocks"), total), F.col("parts"))
    ends, slots = plan.agg(F.min(out), F.max(out + 1)).first()
    known_blocks = plan.select(F.col("source").alias("of"), "blocks")
    made = schedule(plan.drop("blocks"), slots or 0, frame)
    table = stage(made.join(known_blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") < F.col("blocks"))).select("source", "block", "slot"), "mix-slots")
    # A piece has a row with the slots of its blocks, so the texts are dealt out once, for numbering and for their slots.
    first, last = (F.floor(x / block_bytes).cast("long") for x in (F.col("before"), F.col("before") + F.col("bytes") - 1))
    held = offsets.select(F.col("source").alias("of"), "piece", "before", F.explode(F.sequence(first, last)).alias("at"))
    held = held.join(table, F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("block")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"])
    facts = held.groupBy("piece").agg(F.min("before").alias(n["low"]), listed.alias(n["of"]))
    joined = placed.join(facts.withColumnRenamed("piece", n["from"]), F.col(n["piece"]) == F.col(n["from"]))
    block = F.floor((F.col(n["before"]) + F.col(n["low"])) / block_bytes).cast("long")
    slot = F.get(F.col(n["of"]), (block - F.floor(F.col(n["low"]) / block_bytes)).cast("int"))
    kept = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "in_mix")]
    return joined.select(
        *[f"`{c}`" for c in kept], block.alias("mix_block"), slot.alias("mix_slot"), (slot < F.lit(ends)).alias("in_mix")
    )


def mixed_corpus(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """Every row of ``docs`` in the order of the mix; where a source has run out, the others go on by their weights."""
    tag = A.own_names(docs, "row")["row"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(tag), F.col(f"`{source}`").alias("source"),
                         F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    return mix(packed, **settings).repartitionByRange("mix_slot").sortWithinPartitions("mix_slot").select(f"{tag}.*")
