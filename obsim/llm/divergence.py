"""Source divergence audit by single-pass in-memory indexing.

Each task reads its documents once and builds the postings of a block of them in memory, terms counted by language and
source; when the block is full, they are spilled as a run sorted by term. Runs go to hash shards of (language, term), are merged there, and every
term becomes one row with its postings, which drops the rare terms. What follows works on that index alone.

The distance of two sources adds up |p - q| over all kept terms of their language, though most terms are missing from
most sources. For a source s let z(s) be the p of a term that it lacks. The distance starts as V |z(s) - z(u)|; the terms
of one source correct it by |p - z(u)| - |z(s) - z(u)|, which needs only how often each p occurs; and a streaming pass
over the postings corrects the terms that both have. So no term meets a source that lacks it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

LEAST_DOCS = 30
# Added to every count, so that a missing term has a share, too.
SMOOTHING = 5
UNIT = 1_000_000_000
RANKS = 50
# Bytes of the texts of a block; indexing takes about ten times as much memory.
BLOCK_BYTES = 16 << 20
_BATCH = 20_000
# Pairs summed up in a task before they are passed on, and sources of a term that are paired at once.
PAIRS = 1_000_000
_SIDE = 512

# Bytes of a term: ASCII letters, in lower case, and all bytes of other characters.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_POSTING = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])
_POSTING_SQL = "lang string, term binary, source string, count long, docs long"


def terms(body: bytes, piece: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a list for each piece of it; pieces end between terms."""
    letters, at = body.translate(_LETTERS), 0
    while at < len(letters):
        end = letters.find(b" ", at + piece)
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def block_run(block: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of a block of documents ``(lang, source, text)``, sorted by term.

    An empty term marks every group seen, also those without terms.
    """
    places: dict[tuple[str, str], int] = {}
    groups = zip(block.column("lang").to_pylist(), block.column("source").to_pylist())
    group = np.fromiter((places.setdefault(g, len(places)) for g in groups), np.int64, block.num_rows)
    # A copy of the column starts at the beginning of its buffers; letters take as many bytes as before.
    text = pa.concat_arrays([pc.fill_null(block.column("text"), "")])
    _, ends, body = text.buffers()
    letters = (body.to_pybytes() if body else b"").translate(_LETTERS)
    found = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), ends, pa.py_buffer(letters)))
    doc = np.repeat(np.arange(len(text)), np.diff(found.offsets.to_numpy()))
    coded = found.flatten().cast(pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names = coded.dictionary.take(pa.array(order))
    blank = len(names) and not len(names[0].as_buffer())  # splits leave empty terms at the ends of a text
    own = rank[coded.indices.to_numpy()]
    pairs, times = np.unique(((doc << 32) | own)[own > 0] if blank else (doc << 32) | own, return_counts=True)
    key = ((pairs & 0xFFFFFFFF) << 32) | group[pairs >> 32]
    at = np.argsort(key)
    key = key[at]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.add.reduceat(times[at], new) if len(new) else new
    term, source = key[new] >> 32, np.concatenate([np.arange(len(places)), key[new] & 0xFFFFFFFF])
    none, seen = np.zeros(len(places), np.int64), [pa.array(x, pa.string()) for x in zip(*places)]
    return pa.RecordBatch.from_arrays([
        seen[0].take(pa.array(source)), pa.concat_arrays([pa.array([b""] * len(places), pa.binary()), names.take(pa.array(term))]),
        seen[1].take(pa.array(source)), pa.array(np.concatenate([none, count]).astype(np.int64)),
        pa.array(np.concatenate([none, np.diff(new, append=len(key))]).astype(np.int64)),
    ], schema=_POSTING)


def long_run(lang: str, source: str, body: bytes, piece: int) -> pa.RecordBatch:
    """The same for a single text too long for a block, counted piece by piece."""
    counts = Counter()
    for found in terms(body, piece):
        counts.update(found)
    run = sorted(counts)
    columns = ([lang] * (len(run) + 1), [b"", *run], [source] * (len(run) + 1), [0, *map(counts.__getitem__, run)], [0] + [1] * len(run))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _POSTING)], schema=_POSTING)


def block_postings(most: int):
    """Arrow batches ``(lang, source, text)`` to term-sorted runs of ``(lang, term, source, count, docs)``.

    Documents are collected until their texts fill ``most`` bytes, then indexed and spilled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in np.flatnonzero(size > most):
                lang, source, text = (batch.column(c)[int(k)] for c in ("lang", "source", "text"))
                yield long_run(lang.as_py(), source.as_py(), text.as_buffer().to_pybytes(), most)
            batch, size = batch.filter(pa.array(size <= most)), size[size <= most]
            at = 0
            while at < len(size):
                upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), most - held, side="right")))
                parts.append(batch.slice(at, upto - at))
                held += int(size[at:upto].sum())
                at = upto
                if held >= most or at < len(size):
                    yield from _sliced(block_run(pa.concat_batches(parts)))
                    parts, held = [], 0
        if parts:
            yield from _sliced(block_run(pa.concat_batches(parts)))

    return run


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from (batch.slice(at, _BATCH) for at in range(0, batch.num_rows, _BATCH))


def index_rows(least_docs: int):
    """Postings sorted by ``(term, lang, source)`` to one row for each kept term: its documents, count and postings.

    Postings of one source are added up. A term in fewer documents is dropped; the empty one, with all groups, stays.
    What waits for the next batch is one term's postings, at most one for each source.
    """
    schema = pa.schema([
        ("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("count", pa.int64()),
        ("postings", pa.list_(pa.struct([("source", pa.string()), ("count", pa.int64())]))),
    ])

    def starts(batch: pa.RecordBatch, *names: str) -> np.ndarray:
        """Places where any of the columns differs from the row before."""
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for c in (batch.column(x) for x in names):
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False)

    def folded(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = starts(batch, "term", "lang", "source")
        first = batch.take(pa.array(at))
        columns = [pa.array(np.add.reduceat(numbers(batch, c), at)) if c in ("count", "docs") else first.column(c) for c in batch.schema.names]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    def rows(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        docs = np.add.reduceat(numbers(batch, "docs"), at)
        kept = (docs >= least_docs) | (pc.binary_length(batch.column("term").take(pa.array(at))).to_numpy(zero_copy_only=False) == 0)
        length = np.diff(at, append=batch.num_rows)
        own, term = batch.filter(pa.array(np.repeat(kept, length))), batch.take(pa.array(at[kept]))
        ends = np.concatenate([[0], np.cumsum(length[kept])])
        total = np.diff(np.concatenate([[0], np.cumsum(numbers(own, "count"))])[ends])
        postings = pa.StructArray.from_arrays([own.column("source"), own.column("count")], fields=list(schema.field("postings").type.value_type))
        return pa.RecordBatch.from_arrays(
            [term.column("lang"), term.column("term"), pa.array(docs[kept]), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings)],
            schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            if batch.num_rows:
                batch = folded(batch)
                at = starts(batch, "term", "lang")
                held = batch.slice(at[-1])
                if len(at) > 1:
                    yield rows(batch.slice(0, at[-1]), at[:-1])
        if held is not None:
            yield rows(held, np.array([0]))

    return run


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                least_docs: int = LEAST_DOCS, block: int = BLOCK_BYTES) -> DataFrame:
    """The index ``(lang, term binary, docs, count, postings array<struct<source, count>>)``, and a row with an empty term for each lang."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    runs = read.mapInArrow(block_postings(block), _POSTING_SQL)
    merged = runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    return merged.mapInArrow(index_rows(least_docs), "lang string, term binary, docs long, count long, postings array<struct<source: string, count: long>>")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 kinds))``, exactly: by long division, three digits at a time."""
    above, below = count + SMOOTHING, total + SMOOTHING * kinds
    # Whole-number division, for doubles do not hold large counts.
    value = F.call_function("div", above, below)
    rest = above % below
    for _ in range(3):
        value = value * 1_000 + F.call_function("div", rest * 1_000, below)
        rest = rest * 1_000 % below
    return value + 1


def pair_corrections(most: int):
    """Arrow batches ``(lang, postings)`` of terms to ``(lang, a, b, value)``: corrections for terms that a pair shares.

    A posting is ``(no, p, z)``, in the order of ``no``. Sums of a task are passed on when they are many, and a term
    of many sources is paired in blocks, so memory is bounded.
    """

    def added(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
        out = {}
        for lang, parts in held.items():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.concatenate([v for _, v in parts]))
            out[lang] = [(keys, sums)]
        return out

    def rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, ((keys, sums),) in added(held).items():
            for at in range(0, len(keys), 100_000):
                k, v = keys[at:at + 100_000], sums[at:at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(v)], ["lang", "a", "b", "value"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, postings in zip(batch.column("lang").to_pylist(), batch.column("postings")):
                no, p, z = (postings.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                for i in range(0, len(no), _SIDE):
                    for j in range(i, len(no), _SIDE):
                        a, b = slice(i, i + _SIDE), slice(j, j + _SIDE)
                        value = (np.abs(p[a, None] - p[b]) - np.abs(p[a, None] - z[b]) - np.abs(z[a, None] - p[b]) + np.abs(z[a, None] - z[b]))
                        keep = no[a, None] < no[b]
                        held.setdefault(lang, []).append((((no[a, None] << 32) | no[b])[keep], value[keep]))
                        size += int(keep.sum())
                        if size >= most:
                            held = added(held)
                            size = sum(len(k) for ((k, _),) in held.values())
                            if size >= most // 2:
                                yield from rows(held)
                                held, size = {}, 0
        yield from rows(held)

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
          ranks: int = RANKS, block: int = BLOCK_BYTES, pairs: int = PAIRS) -> DataFrame:
    """``(lang, source, part, item, value long, rank int)``: how far each source is from the others of its language.

    Part ``pair``: for each other source of the language the distance, summed over the terms that at least
    ``least_docs`` documents of the language hold (0 if there are none), all ranks. Part ``term``: the terms that the
    source has more of than its language, by the difference of their shares, up to ``ranks``. Ranks go by falling
    value, then by the item's bytes.

    Null text, lang and source count as ''; every group that occurs is reported, also one without terms, and a language
    with a single source has no pairs. Texts of any length are read whole, piece by piece; ids and other columns
    are not read, repeated rows count as often as they occur. An empty table gives an empty result. The pairs are
    as many as the contract asks for, the square of a language's sources; nothing else grows that way but the numbers
    that terms shared by many sources add up inside a task.
    """
    index = stage(frequencies(docs, text, lang, source, least_docs, block), "term-index")
    listed = index.select("lang", "term", F.col("count").alias("all_count"), F.explode("postings").alias("x")).select(
        "lang", "term", "all_count", "x.source", F.col("x.count").alias("count")
    )
    is_term = F.octet_length("term") > 0
    langs = index.groupBy("lang").agg(F.count_if(is_term).alias("kinds"), F.coalesce(F.sum(F.when(is_term, F.col("count"))), F.lit(0)).alias("lang_total"))
    totals = listed.groupBy("lang", "source").agg(F.sum("count").alias("total")).join(langs, "lang")
    within = Window.partitionBy("lang").orderBy("source")
    zero = F.when(F.col("kinds") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kinds"))).otherwise(F.lit(0).cast("long"))
    groups = stage(totals.select("*", zero.alias("z"), F.row_number().over(within).cast("long").alias("no")), "term-groups")

    # Every posting with its shares: one row for each (term, source) that occurs.
    held = stage(listed.filter(is_term).join(groups, ["lang", "source"]).select(
        "lang", "source", "no", "z", "term", share(F.col("count"), F.col("total"), F.col("kinds")).alias("p"),
        share(F.col("all_count"), F.col("lang_total"), F.col("kinds")).alias("q"),
    ), "term-shares")

    # Own terms against what every other source lacks: running sums over a source's different shares and the others' z.
    points = held.groupBy("lang", "no", "z", F.col("p").alias("at")).agg(F.count("*").alias("n")).select("lang", "no", "z", "at", "n", F.lit(None).cast("long").alias("other"))
    ends = groups.select("lang", F.col("no").alias("other"), F.col("z").alias("at"))
    asked = groups.select("lang", "no", "z").join(ends, "lang").filter("no <> other").select("lang", "no", "z", "at", F.lit(0).cast("long").alias("n"), "other")
    own = Window.partitionBy("lang", "no")
    upto = own.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("n") * F.col("at")
    sums = points.unionByName(asked).select(
        "lang", "no", "z", "at", "other", F.sum("n").over(upto).alias("n_low"), F.sum(weight).over(upto).alias("s_low"),
        F.sum("n").over(own).alias("n_all"), F.sum(weight).over(own).alias("s_all"),
    ).filter("other is not null")
    # n_low terms lie at or below the other's z, the rest above it.
    apart = F.col("at") * (2 * F.col("n_low") - F.col("n_all")) + F.col("s_all") - 2 * F.col("s_low")
    single = sums.select(
        "lang", F.least("no", "other").alias("a"), F.greatest("no", "other").alias("b"),
        (apart - F.col("n_all") * F.abs(F.col("z") - F.col("at"))).alias("value"),
    )
    posting = F.array_sort(F.collect_list(F.struct("no", "p", "z"))).alias("postings")
    shared = held.groupBy("lang", "term").agg(posting).filter(F.size("postings") > 1).select("lang", "postings")
    shared = shared.mapInArrow(pair_corrections(pairs), "lang string, a long, b long, value long")
    distance = single.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    first = groups.select("lang", F.col("no").alias("a"), F.col("source").alias("name_a"), F.col("z").alias("za"), "kinds")
    second = groups.select("lang", F.col("no").alias("b"), F.col("source").alias("name_b"), F.col("z").alias("zb"))
    whole = distance.join(first, ["lang", "a"]).join(second, ["lang", "b"]).withColumn("value", F.col("value") + F.col("kinds") * F.abs(F.col("za") - F.col("zb")))
    sides = F.explode(F.array(F.struct(F.col("name_a").alias("source"), F.col("name_b").alias("item")), F.struct(F.col("name_b").alias("source"), F.col("name_a").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = whole.select("lang", "value", sides.alias("x")).select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(order))

    # Only the best of each task and group are shuffled for their rank.
    better = held.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = better.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*out).unionByName(term.withColumn("part", F.lit("term")).select(*out))
