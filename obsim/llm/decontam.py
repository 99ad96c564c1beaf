"""Benchmark decontamination over templates.

Tokens are canonical: numbers, names and units become typed placeholders, all else is the lower-case word. Windows of
canonical tokens of documents and benchmark items meet in a hash join. Along one diagonal of document and item, the
values behind the placeholders must map consistently: where a question was re-parameterised, equal values of the item
stand for equal values of the document. Windows with placeholders also meet by their case-folded words as they stand, so
that no word-for-word copy depends on what is taken for a placeholder. Pieces of three tokens find edited copies.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A
from .shingles import REMEMBERED, signed, windows

WINDOW = 8
# Share of an item's windows that a document must hold.
COVERAGE = 0.5
# Placeholders may make up so much of a window; beyond that it says nothing about its source.
MOST_SLOTS = 4
# Pieces that find edited copies, and how far the diagonals of the parts between edits may lie apart.
PIECE = 3
SHIFT = 3
# One place in so many may contradict the mapping of values, as a slip; one always may.
SLIP = 8
# Up to so many distinct benchmark windows (8 bytes each) go to every task, which then returns only those it finds;
# beyond it all windows of the documents are shuffled to the join.
MOST_BROADCAST = 2_000_000
# Leading bits of a window that are looked up before it is searched for.
HEAD = 20

# Number words and units that count as such.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half "
    "twice dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce "
    "ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years mph kmh percent % degree degrees celsius fahrenheit dollar dollars cent cents euro euros "
    "watt watts volt volts joule joules newton newtons".split()
)
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:%|[a-z]{1,3})?")
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
# The low bits of a packed token: capital letter first, end of a sentence, kind of placeholder.
_CAPITAL, _END, _KIND = 1, 2, 2
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3


class Tokens(dict):
    """Packed 64-bit tokens: hash of the lower-case word above the low four bits of flags."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        # Most words are seen once. Letters and digits have no edges, and letters are no number.
        bare = word if word.isalnum() else _EDGE.sub("", word) or word
        low = bare.lower()
        kind = NUMBER if low in NUMBER_WORDS or not low.isalpha() and _NUMBER.fullmatch(low) else UNIT if low in UNITS else PLAIN
        packed = xxhash.xxh64_intdigest(low if low.isascii() else low.encode("utf-8", "surrogatepass")) & ~15
        packed |= (kind << _KIND) | (_END if word[-1] in ".!?:" else 0) | (_CAPITAL if bare[:1].isupper() and bare[1:].islower() else 0)
        self[word] = packed
        return packed

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical codes, kinds of placeholder, and value codes of the words of a text."""
        words = text.split()
        x = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        kinds = ((x >> np.uint64(_KIND)) & np.uint64(3)).astype(np.int8)
        starts = np.ones(len(x), bool)
        starts[1:] = (x[:-1] & np.uint64(_END)) != 0
        # A capital that does not begin a sentence marks a name; words all in capitals do not tell.
        kinds[((x & np.uint64(_CAPITAL)) != 0) & ~starts & (kinds == PLAIN)] = NAME
        values = x & ~np.uint64(15)
        return np.where(kinds == PLAIN, values, kinds.astype(np.uint64) + np.uint64(1)), kinds, values


_ROWS = "window bigint, at int, kinds array<tinyint>, slots array<bigint>"
_FOUND = "n_hits int, n_windows int, first_word int, reparameterised boolean"


def words_needed(n: int) -> int:
    """Words of an item of ``n`` that pieces must cover: two edits leave so many from 15 words on, one edit below."""
    return math.ceil(0.6 * n) if n >= 15 else max(n - PIECE, 2 * PIECE)


def _most_slots(size: int) -> int:
    """Placeholders in a window that is a whole item or text."""
    return MOST_SLOTS if size > MOST_SLOTS else size - 1


def _windows_of(codes: np.ndarray, kinds: np.ndarray, values: np.ndarray, size: int, most: int):
    """Hashes, places, and whether placeholders stand in them: windows of templates, then of words as they stand."""
    if not 0 < size <= len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    filled = np.concatenate([[0], np.cumsum(kinds != PLAIN)])
    filled = filled[size:] - filled[:-size]
    at, literal = np.flatnonzero(filled <= most), np.flatnonzero(filled)
    found = windows(codes, size)[at]
    if not len(literal):
        return found, at, np.zeros(len(at), bool)
    return (
        np.concatenate([found, windows(values, size)[literal]]), np.concatenate([at, literal]),
        np.concatenate([filled[at] > 0, np.zeros(len(literal), bool)]),
    )


class Known:
    """The windows of all items, sorted, and for pieces the items that hold them and where."""

    def __init__(self, rows: list):
        all_windows = np.array([r["window"] for r in rows], np.int64).view(np.uint64)
        pieces = np.array([r["piece"] for r in rows], bool)
        self.whole = np.unique(all_windows[~pieces])
        order = np.flatnonzero(pieces)[np.argsort(all_windows[pieces], kind="stable")]
        self.held, self.start, self.count = np.unique(all_windows[order], return_index=True, return_counts=True)
        number: dict = {}
        self.item = np.array([number.setdefault((r["item_id"], r["item_key"]), len(number)) for r in rows], np.int64)[order]
        self.offset = np.array([r["offset"] for r in rows], np.int64)[order]
        self.need = np.array([-(-words_needed(r["n_words"]) // PIECE) for r in rows], np.int64)[order]
        self.whole_heads, self.held_heads = self._heads(self.whole), self._heads(self.held)

    @staticmethod
    def _heads(wanted: np.ndarray) -> np.ndarray:
        """Which leading bits of a window some wanted window has."""
        heads = np.zeros(1 << HEAD, bool)
        heads[wanted >> np.uint64(64 - HEAD)] = True
        return heads

    @staticmethod
    def _places(wanted: np.ndarray, heads: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``found`` are among the wanted, searched for only where the leading bits are some wanted window's."""
        hit, place = np.zeros(len(found), bool), np.zeros(len(found), np.int64)
        may = np.flatnonzero(heads[found >> np.uint64(64 - HEAD)])
        if len(may):
            place[may] = np.minimum(np.searchsorted(wanted, found[may]), len(wanted) - 1)
            hit[may] = wanted[place[may]] == found[may]
        return hit, place

    def holds(self, found: np.ndarray) -> np.ndarray:
        return self._places(self.whole, self.whole_heads, found)[0]

    def enough(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pieces that lie, on diagonals close together, among as many of one item as it needs at least."""
        hit, place = self._places(self.held, self.held_heads, found)
        mine, place = np.flatnonzero(hit), place[hit]
        keep = np.zeros(len(found), bool)
        if not len(mine):
            return keep
        count = self.count[place]
        entry = np.repeat(self.start[place] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        mine = np.repeat(mine, count)
        diagonal = at[mine] - self.offset[entry] + (1 << 20)
        for shifted in (0, SHIFT + 1):
            _, back, total = np.unique((self.item[entry] << 40) + (diagonal + shifted) // (2 * SHIFT + 2), return_inverse=True, return_counts=True)
            keep[mine[total[back] >= self.need[entry]]] = True
        return keep


def window_rows(size: int, short: tuple[int, ...] = (), known=None):
    """Arrow batches ``(doc_id, text_key, text)`` to rows of windows; only those of ``known`` (a broadcast) if given.

    ``short``: lengths of the items that are shorter than a window. A text shorter than a window is a window, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        wanted = None if known is None else known.value
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                codes, kinds, values = tokens.of(text)
                own = min(size, len(codes))
                # Within a longer text a short template says as little as its few plain words.
                sizes = [(own, MOST_SLOTS if own == size else _most_slots(own))]
                sizes += [(k, max(0, k - size + MOST_SLOTS)) for k in short if k < len(codes)]
                parts = []
                for width, most in sizes:
                    found, at, filled = _windows_of(codes, kinds, values, width, most)
                    if wanted is not None:
                        hit = wanted.holds(found)
                        found, at, filled = found[hit], at[hit], filled[hit]
                    parts.append((found, at, filled, width))
                found, at, filled = _windows_of(codes, kinds, values, PIECE, 1)
                if wanted is not None:
                    hit = wanted.enough(found, at)
                    found, at, filled = found[hit], at[hit], filled[hit]
                parts.append((found, at, filled, PIECE))
                for found, at, filled, width in parts:
                    for h, p, f in zip(signed(np.ascontiguousarray(found)).tolist(), at.tolist(), filled.tolist()):
                        slot = np.flatnonzero(kinds[p:p + width]) + p if f else at[:0]
                        rows.append(row)
                        for column, value in zip(out, (h, p, kinds[slot].tolist(), signed(values[slot]).tolist())):
                            column.append(value)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 pa.array(out[2], pa.list_(pa.int8())), pa.array(out[3], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "window", "at", "kinds", "slots"],
            )

    return run


_ITEM = "window bigint, offset int, size int, piece boolean, usable boolean, spots array<int>, item_slots array<bigint>, n_words int, n_usable int, n_all int"


def item_rows(size: int):
    """Arrow batches ``(item_id, item_key, text)`` to the rows of ``item_templates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text")):
                codes, kinds, values = tokens.of(text.as_py() or "")
                n = len(codes)
                own = min(size, n)
                most = MOST_SLOTS if own == size else _most_slots(own)
                filled = np.convolve((kinds != PLAIN).astype(np.int64), np.ones(own, np.int64), "valid") if n else np.empty(0, np.int64)
                usable = filled <= most
                parts = [(own, most, False)] + ([(PIECE, 1, True)] if n >= size > PIECE else [])
                for width, limit, piece in parts:
                    for h, p, f in zip(*_windows_of(codes, kinds, values, width, limit)):
                        slot = np.flatnonzero(kinds[p:p + width]) + p if f else np.empty(0, np.int64)
                        rows.append(row)
                        out.append({
                            "window": int(h.view(np.int64)), "offset": int(p), "size": width, "piece": piece,
                            "usable": not piece and bool(usable[p]), "spots": slot.tolist(), "item_slots": signed(values[slot]).tolist(),
                            "n_words": n, "n_usable": int(usable.sum()), "n_all": n - own + 1,
                        })
            take = pa.array(rows, pa.int64())
            made = pa.RecordBatch.from_pylist(out, pa.schema([
                ("window", pa.int64()), ("offset", pa.int32()), ("size", pa.int32()), ("piece", pa.bool_()), ("usable", pa.bool_()),
                ("spots", pa.list_(pa.int32())), ("item_slots", pa.list_(pa.int64())), ("n_words", pa.int32()), ("n_usable", pa.int32()), ("n_all", pa.int32()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *made.columns], ["item_id", "item_key", *made.schema.names]
            )

    return run


def item_templates(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Staged windows and pieces of every item with the values of its own slots; equal texts go by the smallest id."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    texts = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.xxhash64(F.col(f"`{text}`")).alias("item_key"), F.col(f"`{text}`").alias("text"))
    one = texts.filter("text is not null").groupBy("item_key", "text").agg(F.min("item_id").alias("item_id")).select("item_id", "item_key", "text")
    return stage(one.mapInArrow(item_rows(size), f"item_id {kind}, item_key bigint, {_ITEM}"), "item-templates")


def agreeing(hits: list[dict]) -> list[tuple[dict, bool]]:
    """The hits of one diagonal that agree, each with whether some value on the diagonal differs.

    Each value of the item stands for one value of the document: itself, if it is there, else the one at most of its
    places. Other places contradict; of equally frequent values all do. A few are slips, and only their windows go; with
    more of them, only windows that hold the item's own values stay.
    """
    places = {p: (k, x, y) for h in hits for p, k, x, y in zip(h["spots"], h["kinds"], h["item_slots"], h["slots"])}
    values: dict = defaultdict(Counter)
    for k, x, y in places.values():
        values[k, x][y] += 1

    def stands(k: int, x: int) -> int | None:
        if x in values[k, x]:
            return x
        (y, n), *others = values[k, x].most_common(2)
        return None if others and others[0][1] == n else y

    main = {key: stands(*key) for key in values}
    wrong = {p for p, (k, x, y) in places.items() if main[k, x] != y}
    slips = len(wrong) <= max(1, len(places) // SLIP)
    differs = any(x != y for _, x, y in places.values())
    return [(h, differs) for h in hits if h["item_slots"] == h["slots"] or slips and wrong.isdisjoint(h["spots"])]


def judged(coverage: float):
    """Arrow batches of a document's hits of an item to the rows of contaminated documents."""

    def verdict(row: dict) -> dict | None:
        lines: dict = defaultdict(list)
        for h in row["hits"]:
            lines[h["at"] - h["offset"]].append(h)
        good = {d: agreeing(hits) for d, hits in lines.items()}
        whole = [(h, differs) for hits in good.values() for h, differs in hits if not h["piece"]]
        usable, every = {h["offset"] for h, _ in whole if h["usable"]}, {h["offset"] for h, _ in whole}
        counts, counted = (len(every), row["n_all"]), []
        if len(every) >= coverage * row["n_all"]:
            counted = whole
        elif usable and len(usable) >= coverage * row["n_usable"]:
            counted, counts = [x for x in whole if x[0]["usable"]], (len(usable), row["n_usable"])
        elif any(h["piece"] for h in row["hits"]):
            for d in sorted(good):
                near = [x for e in range(d, d + SHIFT + 1) for x in good.get(e, ())]
                words = {o for h, _ in near for o in range(h["offset"], h["offset"] + h["size"])}
                if len(words) >= words_needed(row["n_words"]):
                    counted += near
        if not counted:
            return None
        return {"n_hits": counts[0], "n_windows": counts[1], "first_word": min(h["at"] for h, _ in counted), "reparameterised": any(x for _, x in counted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(row) for row in batch.select(["hits", "n_words", "n_usable", "n_all"]).to_pylist()]
            take = pa.array([k for k, x in enumerate(found) if x], pa.int64())
            made = pa.RecordBatch.from_pylist([x for x in found if x], pa.schema([
                ("n_hits", pa.int32()), ("n_windows", pa.int32()), ("first_word", pa.int32()), ("reparameterised", pa.bool_()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in range(3)), *made.columns], ["doc_id", "text_key", "item_id", *made.schema.names]
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, text_key, item_id, n_hits, n_windows, first_word, reparameterised)`` of contaminated documents.

    A document holds an item if windows whose slots agree along their diagonal make up at least ``coverage`` of the
    item's windows, or of those with few enough placeholders. It holds an edited item if pieces on diagonals close
    together cover as many of its words as one or two edits leave (``words_needed``); ``n_hits`` may then be 0.
    ``reparameterised``: some value behind a placeholder differs from the item's. Items with one template are judged
    each by its own values. Null, empty and wordless texts and items match nothing; an item shorter than a window is
    matched wherever it stands word for word, by its template where four words are plain or the text has its length;
    repeated rows give one result for each id and text; empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = item_templates(benchmark, item_id, item_text, size)
    short = tuple(sorted(r[0] for r in items.filter(f"not piece and size < {size}").select("size").distinct().collect()))
    known = None
    if items.count() <= MOST_BROADCAST:
        known = spark.sparkContext.broadcast(Known(items.select("item_id", "item_key", "window", "piece", "offset", "n_words").collect()))
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    held = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(window_rows(size, short, known), f"doc_id {kind}, text_key bigint, {_ROWS}")
    met = held.join(items, "window")
    hit = F.struct("at", "offset", "size", "piece", "usable", "spots", "item_slots", "kinds", "slots")
    pairs = met.groupBy("doc_id", "text_key", "item_id", "item_key", "n_words", "n_usable", "n_all").agg(F.collect_set(hit).alias("hits"))
    return pairs.select("doc_id", "text_key", "item_id", "hits", "n_words", "n_usable", "n_all").mapInArrow(
        judged(coverage), f"doc_id {kind}, text_key bigint, item_id {item_kind}, {_FOUND}"
    ).groupBy("doc_id", "text_key", "item_id").agg(
        F.max("n_hits").alias("n_hits"), F.max("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"), F.min("reparameterised").alias("reparameterised")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    n = A.own_names(docs, "id", "key")
    gone = leaks(docs, benchmark, doc_id, text, **settings).select(F.col("doc_id").alias(n["id"]), F.col("text_key").alias(n["key"])).distinct()
    keyed = docs.withColumn(n["key"], F.xxhash64(F.col(f"`{text}`")))
    return keyed.join(gone, (keyed[n["key"]] == gone[n["key"]]) & keyed[doc_id].eqNullSafe(gone[n["id"]]), "left_anti").drop(n["key"])
