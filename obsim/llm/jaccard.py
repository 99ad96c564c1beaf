"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Texts with equal n-gram sets form one set class and travel as one. Classes that share a band hash meet in a bucket; each
is verified against the bucket's first class, which costs as many pairs as members, and links are contracted to groups.
Where a bucket still holds several groups, all pairs of classes across them are verified too, in blocks where there are
many. So whatever pair of a bucket is left out lies inside one group already, and no group is split: groups are exactly
those of all candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A
from .components import components
from .shingles import WordCodes, mixed, shingle_set, signed

WORDS = 5
SIMILARITY = 0.8
# Chance that a pair just at the threshold shares a band.
RECALL = 0.999
MOST_HASHES = 160
# Buckets of up to so many classes list their pairs across groups; larger ones are compared in blocks of BLOCK classes.
LISTED = 32
BLOCK = 512


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most selective banding within ``most`` hashes whose recall at the threshold is reached."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-max(similarity**rows, 1e-300))) if similarity < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"recall {recall} needs over {most} hashes")


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return seeds[:count] | np.uint64(1), seeds[count:]


def signatures(words: int, bands: int, rows: int):
    """Arrow batches ``(doc_id, text_key, text)`` to ``(doc_id, text_key, set_key, n_grams, band_keys)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (a, b) = WordCodes(), _multipliers(bands * rows)
        a, b = a[:, None], b[:, None]
        for batch in batches:
            keys, counts, banded = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                grams = shingle_set(codes.of(text.split()), words) if text else np.empty(0, np.uint64)
                counts.append(len(grams))
                if not len(grams):
                    keys.append(None)
                    banded.append(None)
                    continue
                keys.append(int(signed(np.array([xxhash.xxh64_intdigest(grams.tobytes())], np.uint64))[0]))
                lowest = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(grams), 4096):  # bounded memory for long texts
                    np.minimum(lowest, (grams[at:at + 4096] * a + b).min(axis=1), out=lowest)
                band = np.zeros(bands, np.uint64)
                for r in range(rows):
                    band = mixed(band + lowest[r::rows])
                banded.append(signed(band))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.int64()), pa.array(counts, pa.int32()),
                 pa.array(banded, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "set_key", "n_grams", "band_keys"],
            )

    return run


def verifier(words: int, similarity: float):
    """Arrow batches ``(a, b, text_a, text_b)`` to the pairs ``(a, b, jaccard)`` that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        last = (None, None)
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if last[0] != a:
                    last = (a, shingle_set(codes.of(ta.split()), words))
                x, y = last[1], shingle_set(codes.of(tb.split()), words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                value = common / (len(x) + len(y) - common)
                if value >= similarity:
                    out.append((a, b, value))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "jaccard"]
            )

    return run


def cell_verifier(words: int, similarity: float):
    """One cell: every asker against every member of another group, through an index of the members' n-grams."""

    def run(cell: pa.Table) -> pa.Table:
        codes = WordCodes()
        ask = cell.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        keys, roots = cell.column("set_key").to_numpy(), cell.column("root").to_numpy()
        sets = [shingle_set(codes.of(t.as_py().split()), words) for t in cell.column("text")]
        members = np.flatnonzero(~ask)
        found = ([], [], [])
        if len(members):
            sizes = np.array([len(sets[m]) for m in members])
            grams = np.concatenate([sets[m] for m in members])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], np.repeat(np.arange(len(members)), sizes)[order]
            for x in np.flatnonzero(ask):
                low, high = np.searchsorted(grams, sets[x], "left"), np.searchsorted(grams, sets[x], "right")
                length = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                common = np.bincount(owner[at], minlength=len(members))
                value = common / (len(sets[x]) + sizes - common)
                for m in np.flatnonzero((value >= similarity) & (roots[members] != roots[x])):
                    y = keys[members[m]]
                    found[0].append(min(keys[x], y))
                    found[1].append(max(keys[x], y))
                    found[2].append(value[m])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "jaccard": pa.array(found[2], pa.float64())})

    return run


def partner_counter(words: int, similarity: float):
    """One cell of a group: how many classes of the other block are similar to each class, as ``(set_key, n_links)``."""

    def run(cell: pa.Table) -> pa.Table:
        codes = WordCodes()
        own, low, high = (cell.column(c).to_numpy() for c in ("own", "low", "high"))
        sets = [shingle_set(codes.of(t.as_py().split()), words) for t in cell.column("text")]
        members, askers = np.flatnonzero(own == high), np.flatnonzero(own == low)
        counts = np.zeros(len(sets), np.int64)
        if len(members) and len(askers):
            sizes = np.array([len(sets[m]) for m in members])
            grams = np.concatenate([sets[m] for m in members])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], np.repeat(np.arange(len(members)), sizes)[order]
            for x in askers:
                first, last = np.searchsorted(grams, sets[x], "left"), np.searchsorted(grams, sets[x], "right")
                length = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                common = np.bincount(owner[at], minlength=len(members))
                similar = members[common / (len(sets[x]) + sizes - common) >= similarity]
                similar = similar[similar != x]
                counts[x] += len(similar)
                if low[x] != high[x]:
                    counts[similar] += 1
        return pa.table({"set_key": cell.column("set_key"), "n_links": pa.array(counts, pa.int64())})

    return run


class JaccardJoin:
    """The join of a table of texts with itself. Every table below is staged in the shared folder.

    ``rows``: one row per input row: ``doc_id, text_key, set_key, n_grams``.
    ``links``: the verified pairs ``(a, b, jaccard)`` of set classes that hold the groups together, ``a < b``; ``degrees``
    counts all similar pairs of a group.
    ``groups``: ``(set_key, root)`` for classes with a link.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                 similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity, self.words = similarity, words
        bands, rows = choose_bands(similarity, recall)
        id_type = docs.schema[doc_id].dataType.simpleString()
        self.docs = docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text")
        )
        signed_rows = stage(self.docs.mapInArrow(
            signatures(words, bands, rows),
            f"doc_id {id_type}, text_key bigint, set_key bigint, n_grams int, band_keys array<bigint>",
        ), "signatures")
        self.rows = signed_rows.drop("band_keys")
        present = signed_rows.filter("set_key is not null")
        # Equal sets have equal bands, so any row of a class gives them.
        buckets = stage(
            present.select("set_key", F.posexplode("band_keys").alias("band", "key")).distinct()
            .join(self._shared(present), ["band", "key"]), "buckets"
        )
        self.texts = self._texts(present, buckets)
        first = self._verified(buckets.filter("set_key <> lead").select(F.col("lead").alias("a"), F.col("set_key").alias("b")).distinct())
        groups = stage(components(first.select("a", "b")), "groups")
        second = self._across(buckets, groups)
        self.links = first.unionByName(second)
        self.groups = groups
        if not second.isEmpty():
            self.groups = stage(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second.select("a", "b"))), "groups")
        self.groups = self.groups.withColumnsRenamed({"node": "set_key"})

    @staticmethod
    def _shared(present: DataFrame) -> DataFrame:
        """Buckets with several classes, and the first class of each."""
        return (
            present.select("set_key", F.posexplode("band_keys").alias("band", "key")).groupBy("band", "key")
            .agg(F.min("set_key").alias("lead"), F.max("set_key").alias("last")).filter("lead < last").drop("last")
        )

    def _texts(self, present: DataFrame, buckets: DataFrame) -> DataFrame:
        """``(set_key, text)``: one text of each class that shares a bucket."""
        asked = buckets.select("set_key").distinct()
        # One text stands for a class; of the rows that hold it, the first id and no other brings it.
        owner = present.join(asked, "set_key").groupBy("set_key").agg(F.min("text_key").alias("text_key"))
        one = present.join(owner, ["set_key", "text_key"]).groupBy("set_key", "text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        found = self.docs.join(one, (self.docs["text_key"] == one["text_key"]) & self.docs["doc_id"].eqNullSafe(one["doc_id"]))
        return stage(found.select("set_key", "text"), "texts")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        texts = self.texts
        both = (
            pairs.join(texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b")
        )
        return stage(both.mapInArrow(verifier(self.words, self.similarity), "a bigint, b bigint, jaccard double").distinct(), "links")

    def _across(self, buckets: DataFrame, groups: DataFrame) -> DataFrame:
        """Verified pairs of classes that share a bucket but lie in different groups.

        The largest group of a bucket need not be compared with itself, so only the other members ask. Small buckets
        list their pairs. In larger ones askers and members are cut into blocks, and each cell of two blocks is compared
        in one task, which returns verified pairs alone.
        """
        named = buckets.join(groups.withColumnsRenamed({"node": "set_key"}), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
        sizes = named.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("band", "key").agg(
            F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("n_groups")
        ).filter("n_groups > 1").select("band", "key", "members", (F.col("members") - F.col("top.n")).alias("askers"), F.col("top.root").alias("top"))
        # The first class of a bucket was compared with everyone already.
        mixed_ones = stage(named.join(largest, ["band", "key"]).filter("set_key <> lead"), "mixed-buckets")
        asks = F.col("root") != F.col("top")

        small = mixed_ones.filter(F.col("members") <= LISTED)
        asking = small.filter(asks).select("band", "key", F.col("set_key").alias("x"), F.col("root").alias("rx"))
        members = small.select("band", "key", F.col("set_key").alias("y"), F.col("root").alias("ry"), "top")
        pairs = asking.join(members, ["band", "key"]).filter("rx <> ry and (ry = top or x < y)")
        listed = self._verified(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

        def spread(count: str) -> Column:
            return F.sequence(F.lit(0), F.ceil(F.col(count) / BLOCK).cast("int") - 1)

        def own(count: str) -> Column:
            return F.pmod(F.xxhash64("set_key"), F.ceil(F.col(count) / BLOCK)).cast("int")

        large = mixed_ones.filter(F.col("members") > LISTED)
        cells = large.filter(asks).withColumns({"ask_block": own("askers"), "member_block": F.explode(spread("members")), "asks": F.lit(True)}).unionByName(
            large.withColumns({"member_block": own("members"), "ask_block": F.explode(spread("askers")), "asks": F.lit(False)})
        )
        cells = cells.select("band", "key", "ask_block", "member_block", "asks", "set_key", "root").join(self.texts, "set_key")
        blocked = cells.groupBy("band", "key", "ask_block", "member_block").applyInArrow(
            cell_verifier(self.words, self.similarity), "a bigint, b bigint, jaccard double"
        )
        return stage(listed.unionByName(blocked).distinct(), "links")

    def degrees(self) -> DataFrame:
        """``(set_key, n_links)``: the classes of its group to which a class is similar, each pair compared once.

        A group is cut into blocks, and each cell of two blocks is compared in one task, which returns counts alone.
        """
        sizes = self.groups.groupBy("root").agg(F.count("*").alias("members"))
        sized = self.groups.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        # A group of two is a link.
        pairs = sized.filter("members = 2").select("set_key", F.lit(1).cast("long").alias("n_links"))
        own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
        cells = sized.filter("members > 2").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("root", "set_key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        counted = cells.join(self.texts, "set_key").groupBy("root", "low", "high").applyInArrow(
            partner_counter(self.words, self.similarity), "set_key bigint, n_links bigint"
        )
        return pairs.unionByName(counted.groupBy("set_key").agg(F.sum("n_links").alias("n_links")))

    def documents(self) -> DataFrame:
        """One row per input row: ``doc_id, class_id, n_links, n_copies``.

        ``class_id``: smallest id of the row's group of near duplicates. ``n_links``: other set classes of the group that
        are similar to the row's own, all pairs of the group compared. ``n_copies``: rows with an equal set, itself included. Rows without a
        word have no n-grams: they are their own class and have no links.
        """
        degree = self.degrees()
        classes = self.rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
        classes = classes.join(self.groups, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
        heads = classes.groupBy("root").agg(F.min("first").alias("class_id"))
        per_class = classes.join(heads, "root").join(degree, "set_key", "left").select(
            "set_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
        )
        return self.rows.join(per_class, "set_key", "left").select(
            "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        )

    def surplus(self) -> DataFrame:
        """``(doc_id, text_key)`` of the rows that are not the first of their group."""
        tagged = self.rows.filter("set_key is not null").join(self.groups, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
        head = tagged.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.count("*").alias("n")).filter("n > 1")
        return tagged.join(head, "root").filter(
            ~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key")))
        ).select("doc_id", "text_key").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Group ids of near-duplicate texts: word 5-gram Jaccard similarity of 0.8 or more, at the stated recall.

    See ``JaccardJoin.documents`` for the columns. Null and empty texts stay alone, texts shorter than the window match
    only equal ones, repeated rows count as copies, an empty table gives an empty result.
    """
    return JaccardJoin(docs, doc_id, text, **settings).documents()


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest id stays.

    Rows that agree in id and text are one row here. Rows without a word are never duplicates.
    """
    found = JaccardJoin(docs, doc_id, text, **settings)
    n = A.own_names(docs, "id", "key")
    gone = found.surplus().withColumnsRenamed({"doc_id": n["id"], "text_key": n["key"]})
    keyed = docs.withColumn(n["key"], F.xxhash64(F.col(f"`{text}`")))
    left = keyed.join(gone, (keyed[n["key"]] == gone[n["key"]]) & keyed[doc_id].eqNullSafe(gone[n["id"]]), "left_anti")
    twice = found.rows.filter("set_key is not null").groupBy("doc_id", "text_key").count().filter("count > 1")
    if not twice.isEmpty():
        worded = F.col(f"`{text}`").rlike(r"\S")
        left = left.filter(worded).dropDuplicates([doc_id, n["key"]]).union(left.filter(~F.coalesce(worded, F.lit(False))))
    return left.drop(n["key"])
