"""Exact removal of repeated byte strings, by suffix arrays over small groups of contexts.

Any string of ``length`` bytes holds an anchor: of its windows of ``CORE`` bytes the one with the smallest hash, the
first among equals. Equal strings have equal anchors in the same place, so a string repeats only among the occurrences
of one anchor. An anchor's context is the bytes of all strings that it anchors; consecutive strings share it.

1. Each text emits its anchors: hash of the core, hash of the context, where its strings start. Anchors whose core occurs
   once are dropped.
2. Contexts that occur twice or more are repeated entirely: counted, never compared.
3. What is left differs somewhere from every other context of its core. Contexts of one core are laid over each other,
   columns with the same pattern of equality become one symbol, and the suffix array of these symbol strings, built by
   linear grouping (``lyndon``), tells how far each context agrees with its neighbours.
4. A core with very many different contexts is not gathered: its contexts are cut into narrower ones, around longer
   cores, and go through 2 and 3 again; at width one a context is the string itself, and counting suffices.

No step compares pairs of texts, and every count is combined before its shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .lyndon import common_prefixes, suffix_array
from .shingles import mixed, signed

LENGTH = 400
# Bytes of an anchor's core. Longer cores meet less by chance, shorter ones give fewer anchors.
CORE_SHARE = 0.4
# Different contexts of one core that are laid over each other in one task.
TOGETHER = 1_024
# Strings of a context when a core has more than that, and then when it still has.
WIDTHS = (16, 1)
# Cores are dealt to so many tasks' worth of contexts.
PER_CELL = 512
# Up to so many rows of a join side go to every task; beyond it both sides are shuffled.
MOST_BROADCAST = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
# Positions inside one stretch of a text fit in the low bits of an ordering value.
_POSITION_BITS = np.uint64(24)
_STRETCH = 4_000_000


class Hasher:
    """Hashes of any substrings of a byte array from running sums (arithmetic modulo 2**64)."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, x in (("power", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        self._grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.power[:n], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - width + 1
    return np.minimum(back[:k], ahead[width - 1:width - 1 + k])


def anchors_of(data: np.ndarray, hasher: Hasher, length: int, core: int):
    """``(core hash, context hash, anchor, first start, last start)`` of the runs of strings that share an anchor."""
    out = []
    for left in range(0, max(len(data) - length + 1, 0), _STRETCH):
        part = data[left:left + _STRETCH + length - 1]
        n, width = len(part), length - core + 1
        hasher.load(part)
        at = np.arange(n - core + 1)
        hashes = hasher.between(at, at + core)
        values = (hashes >> _POSITION_BITS << _POSITION_BITS) | at.astype(np.uint64)
        anchor = (_least_of_windows(values, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        anchor = anchor[first]
        context = mixed(hasher.between(first, last + length) + (anchor - first).astype(np.uint64) * _BASE)
        out.append((hashes[anchor], context, anchor + left, first + left, last + left))
    return [np.concatenate(x) for x in zip(*out)] if out else None


ANCHORS = "core bigint, context bigint, text_key bigint, at int, first int, last int"
PIECES = "core bigint, context bigint, text_key bigint, at int, first int, last int, weight int, body binary"


def emit_anchors(length: int, core: int):
    """Arrow batches ``(text_key, text)`` to anchor rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = []
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text")):
                text = text.as_py()
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
                if len(data) >= length:
                    core_hash, context, at, first, last = anchors_of(data, hasher, length, core)
                    found.append((signed(core_hash), signed(context), np.full(len(at), key, np.int64), at, first, last))
            cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in cols[:3]] + [pa.array(c.astype(np.int32)) for c in cols[3:]],
                ["core", "context", "text_key", "at", "first", "last"],
            )

    return run


def emit_bodies(length: int):
    """Arrow batches ``(text, wanted: array of anchor rows)`` to anchor rows with the bytes of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                rows += [w | {"body": data[w["first"]:w["last"] + length]} for w in wanted]
            yield pa.RecordBatch.from_pylist(rows, _PIECE_TYPES)

    return run


_PIECE_TYPES = pa.schema([
    ("core", pa.int64()), ("context", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("first", pa.int32()),
    ("last", pa.int32()), ("weight", pa.int32()), ("body", pa.binary()),
])


def narrower(length: int, width: int):
    """Arrow batches of pieces to pieces of at most ``width`` strings each, whose core is all that these share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                data = np.frombuffer(p["body"], np.uint8)
                hasher.load(data)
                # Cut at fixed distances from the anchor, so that equal strings fall into like pieces.
                start = p["first"]
                while start <= p["last"]:
                    cell = (p["at"] - start) // width
                    low, high = p["at"] - cell * width - width + 1, p["at"] - cell * width
                    end = min(p["last"], high)
                    a, b = np.array([high - p["first"]]), np.array([low + length - p["first"]])
                    # All strings of the cell share what lies between a and b, also where this context lacks some of them.
                    tag = np.uint64((p["core"] + (cell + 1) * int(_BASE)) % (1 << 64))
                    whole = hasher.between(np.array([start - p["first"]]), np.array([end + length - p["first"]]))
                    rows.append(p | {
                        "core": int(signed(mixed(hasher.between(a, b) + tag))[0]),
                        "context": int(signed(mixed(whole + tag + np.uint64(p["at"] - start)))[0]),
                        "first": start, "last": end, "body": p["body"][start - p["first"]:end + length - p["first"]],
                    })
                    start = end + 1
            yield pa.RecordBatch.from_pylist(rows, _PIECE_TYPES)

    return run


def _agreement(a: bytes, b: bytes) -> int:
    """Equal bytes from the start of both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        middle = (low + high) // 2
        if a[low:middle + 1] == b[low:middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


def _longest_agreement(strings: list[bytes]) -> list[int]:
    """For each string the equal bytes from the start that it shares with any other; neighbours in order share most."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:]):
        shared = _agreement(strings[i], strings[j])
        out[i], out[j] = max(out[i], shared), max(out[j], shared)
    return out


def agreeing_starts(at: np.ndarray, first: np.ndarray, bodies: list[bytes], length: int, core: int) -> list[tuple[int, int, int]]:
    """``(row, low, high)``: starts of strings of a row that also start in another row, at the same distance of the anchor.

    Rows are contexts of one core, laid over each other at their anchors. What lies further from the core than a row
    agrees with any other, on either side, is cut off first; few rows are then long enough to hold a repeated string.
    """
    ahead = (at - first).tolist()
    before = _longest_agreement([b[:a][::-1] for b, a in zip(bodies, ahead)])
    behind = _longest_agreement([b[a + core:] for b, a in zip(bodies, ahead)])
    rows = [r for r in range(len(bodies)) if before[r] + core + behind[r] >= length]
    if len(rows) < 2:
        return []
    cut = [bodies[r][ahead[r] - before[r]:ahead[r] + core + behind[r]] for r in rows]
    starts = np.array([int(at[r]) - before[r] for r in rows])
    return [(rows[row], low, high) for row, low, high in _agreeing(at[rows], starts, cut, length)]


def _agreeing(at: np.ndarray, first: np.ndarray, bodies: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """The same for rows that agree with some other at every byte next to the core, by the suffix array of their symbols."""
    left = int((at - first).max())
    offset = left - (at - first)
    columns = int(max(o + len(b) for o, b in zip(offset, bodies)))
    grid = np.full((len(bodies), columns), -1, np.int16)
    for row, (o, body) in enumerate(zip(offset, bodies)):
        grid[row, o:o + len(body)] = np.frombuffer(body, np.uint8)
    # What stands in a column is named by the first row that has it: equal bytes are runs of the sorted column.
    order = np.argsort(grid, axis=0, kind="stable")
    ranked = np.take_along_axis(grid, order, 0)
    opens = np.ones(grid.shape, bool)
    opens[1:] = ranked[1:] != ranked[:-1]
    run = np.maximum.accumulate(np.where(opens, np.arange(len(bodies))[:, None], 0), axis=0)
    names = np.empty(grid.shape, np.int64)
    np.put_along_axis(names, order, np.take_along_axis(order, run, 0), 0)
    # A byte that no other row has in its column ends every string around it.
    single = opens.copy()
    single[:-1] &= opens[1:]
    alone = np.empty(grid.shape, bool)
    np.put_along_axis(alone, order, single, 0)
    names[alone | (grid < 0)] = -1
    # Columns with the same pattern of equality as the one before are one symbol.
    new = np.ones(columns, bool)
    new[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], columns)
    symbols, places = [], []
    for row in range(len(bodies)):
        named = names[row, begins]
        usable = named >= 0
        # Only runs of usable segments that are as long as a string can hold one.
        edges = np.flatnonzero(np.diff(np.concatenate([[0], usable.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if ends[b - 1] - begins[a] >= length:
                symbols += [int(s) * len(bodies) + int(x) + 1 for s, x in zip(range(a, b), named[a:b])]
                places += [(row, s) for s in range(a, b)]
                symbols.append(0)
                places.append((-1, -1))
    if not symbols:
        return []
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order)
    out = []
    for k, i in enumerate(order):
        row, segment = places[i]
        if row < 0:
            continue
        # A separator is shared with other separators; agreement ends before it.
        most = max(shared[k], shared[k + 1] if k + 1 < len(order) else 0)
        reach = 0
        while reach < most and symbols[i + reach]:
            reach += 1
        if reach:
            low = begins[segment]
            high = min(ends[segment] - 1, ends[segment + reach - 1] - length)
            if high >= low:
                out.append((row, int(low - offset[row]) + int(first[row]), int(high - offset[row]) + int(first[row])))
    return out


def compare_cell(length: int, core_length: int):
    """All pieces of a cell, core by core, to ``(text_key, low, high)`` of repeated starts."""

    def run(cell: pa.Table) -> pa.Table:
        core = cell.column("core").to_numpy()
        at, first = cell.column("at").to_numpy().astype(np.int64), cell.column("first").to_numpy().astype(np.int64)
        keys, bodies = cell.column("text_key").to_numpy(), cell.column("body").to_pylist()
        order = np.argsort(core, kind="stable")
        out = ([], [], [])
        for rows in np.split(order, np.flatnonzero(np.diff(core[order])) + 1) if len(order) else []:
            if len(rows) > 1:
                for row, low, high in agreeing_starts(at[rows], first[rows], [bodies[r] for r in rows], length, core_length):
                    for column, value in zip(out, (keys[rows[row]], low, high)):
                        column.append(value)
        return pa.table({"text_key": pa.array(out[0], pa.int64()), "low": pa.array(out[1], pa.int32()), "high": pa.array(out[2], pa.int32())})

    return run


STARTS = "text_key bigint, low int, high int"


def _met(pieces: DataFrame) -> DataFrame:
    """``(core, context, times, contexts, holder)`` of cores that occur more than once.

    ``times``: rows of the context by weight, ``contexts``: different contexts of the core, ``holder``: a text key.
    """
    per = pieces.groupBy("core", "context").agg(F.sum("weight").alias("times"), F.min("text_key").alias("holder"))
    cores = per.groupBy("core").agg(F.count("*").alias("contexts"), F.sum("times").alias("all")).filter("all > 1").drop("all")
    return per.join(cores, "core")


def _settle(pieces: DataFrame, length: int, core: int, widths: tuple[int, ...], together: int) -> list[DataFrame]:
    """Repeated starts among pieces with bodies, level by level."""
    met = stage(_met(pieces), "contexts")
    known = pieces.join(met, ["core", "context"])
    whole = known.filter("times > 1").select("text_key", F.col("first").alias("low"), F.col("last").alias("high"))
    out = [whole]
    # One holder stands for a repeated context.
    rest = known.filter("contexts > 1 and (times = 1 or text_key = holder)").withColumn(
        "weight", F.least("times", F.lit(2)).cast("int")
    )
    columns = [c.split()[0] for c in PIECES.split(", ")]
    rest = stage(rest.select(*columns, "contexts"), "open-contexts")
    few = rest.filter(F.col("contexts") <= together).drop("contexts")
    # So many cells that each holds about PER_CELL pieces, or one core of up to ``together``.
    cells = max(1, -(-few.count() // PER_CELL))
    out.append(few.groupBy(F.pmod(F.xxhash64("core"), F.lit(cells)).alias("cell")).applyInArrow(compare_cell(length, core), STARTS))
    many = rest.filter(F.col("contexts") > together).drop("contexts")
    if widths and not many.isEmpty():
        cut = stage(many.mapInArrow(narrower(length, widths[0]), PIECES), "narrower")
        # At width one, pieces are single strings, and different contexts of a core are different strings.
        out += _settle(cut, length, core, widths[1:], together) if widths[1:] else [
            cut.join(_met(cut).filter("times > 1"), ["core", "context"]).select("text_key", F.col("first").alias("low"), F.col("last").alias("high"))
        ]
    return out


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a join side only where its counted rows stay under the bound."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """Staged ``(text_key, starts, ends)``: merged byte ranges of each text that repeated strings cover."""
    keyed = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text")
    )
    core = max(1, int(length * CORE_SHARE))
    anchors = stage(keyed.select("text_key", "text").mapInArrow(emit_anchors(length, core), ANCHORS), "anchors")
    often = anchors.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    anchors = stage(anchors.join(often, "core").withColumn("weight", F.lit(1)), "met-anchors")
    met = stage(_met(anchors), "contexts")
    known = anchors.join(met, ["core", "context"])
    marks = [known.filter("times > 1").select("text_key", F.col("first").alias("low"), F.col("last").alias("high"))]

    # Contexts that still need their bytes: single ones whose core has others, and one occurrence of each repeated one.
    # Occurrences of a context have the same distances between start, anchor and end.
    open_rows = known.filter("contexts > 1 and (times = 1 or text_key = holder)").groupBy("core", "context", "text_key").agg(
        F.min("first").alias("first"), F.min(F.col("at") - F.col("first")).alias("ahead"),
        F.min(F.col("last") - F.col("first")).alias("more"), F.min(F.least("times", F.lit(2))).cast("int").alias("weight"),
    )
    one = F.struct(
        "core", "context", "text_key", (F.col("first") + F.col("ahead")).alias("at"), "first",
        (F.col("first") + F.col("more")).alias("last"), "weight",
    )
    wanted = stage(open_rows.groupBy("text_key").agg(F.collect_list(one).alias("wanted")), "wanted")
    # One row stands for all copies of a text: the one with the smallest id.
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    owner = ids.join(wanted.select("text_key"), "text_key").groupBy("text_key").agg(F.min("doc_id").alias("owner"))
    asked = stage(wanted.join(owner, "text_key").withColumnRenamed("text_key", "asked"), "asked")
    rows = asked.agg(F.sum(F.size("wanted"))).first()[0] or 0
    bodies = keyed.join(_sent(asked, rows), (F.col("text_key") == F.col("asked")) & F.col("doc_id").eqNullSafe(F.col("owner")))
    pieces = bodies.select("text", "wanted").mapInArrow(emit_bodies(length), PIECES)
    # Only rows that agree in id and text bring a piece twice; it counts once.
    pieces = stage(pieces.dropDuplicates(["core", "context", "text_key", "first"]), "pieces")
    marks += _settle(pieces, length, core, tuple(w for w in WIDTHS if w == 1 or 2 * w < length), together)

    starts = marks[0]
    for more in marks[1:]:
        starts = starts.unionByName(more)
    # Copies repeat each other's rows, which are dropped before a text's ranges come together.
    ranges = starts.distinct().groupBy("text_key").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    return stage(ranges.mapInArrow(merge_ranges(length), "text_key bigint, starts array<int>, ends array<int>"), "spans")


def merge_ranges(length: int):
    """Arrow batches of starts of repeated strings to merged byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for low, high in zip(batch.column("low"), batch.column("high")):
                low, high = np.array(low.as_py(), np.int64), np.array(high.as_py(), np.int64) + length
                order = np.argsort(low, kind="stable")
                low, reach = low[order], np.maximum.accumulate(high[order])
                cut = np.flatnonzero(low[1:] > reach[:-1]) + 1
                starts.append(low[np.concatenate([[0], cut])].tolist())
                ends.append(reach[np.concatenate([cut - 1, [len(low) - 1]])].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                ["text_key", "starts", "ends"],
            )

    return run


def apply_spans():
    """Arrow batches ``(..., text, starts, ends)``: the remaining text as bytes, with counts and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, hashes, kept = [], [], [], [], []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                starts, ends = starts.as_py() or [], ends.as_py() or []
                left = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(len(starts))
                hashes.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(hashes, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Removed is every byte inside a string of ``length`` bytes that also starts elsewhere, in any text or the same one,
    overlapping or not. Texts are UTF-8 bytes; ``kept`` (binary) joins what remains. Null and empty texts have no bytes;
    texts shorter than ``length`` stay whole; of equal texts that long nothing remains in any row, repeated rows
    included. Null or repeated ids are ordinary rows, other columns of ``docs`` play no part, and an empty table gives
    an empty result. Strings are compared by 64-bit hashes of theirs or of their contexts.
    """
    spans = repeated_spans(docs, doc_id, text, length, together)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = spans.agg(F.sum(F.size("starts"))).first()[0] or 0
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    return keyed.join(_sent(spans, rows), "text_key", "left").select("doc_id", "text", "starts", "ends").mapInArrow(
        apply_spans(), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
