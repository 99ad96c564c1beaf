"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words. Two lines are within one edit (a word replaced, added or left out) exactly if deleting at
most one word from each gives equal sequences, so each line emits the hashed keys of its variants and lines that share a
key are neighbours. All lines of one key are within the bound of each other; each is joined to the earliest, verified,
and goes if that one stands before it.

Only lines that can have a neighbour emit variants: with one edit, either the first or the second half stays equal, so
lines that share neither end with another line are set aside first, without loss.

Built-in expressions throughout. Keys of variants combine a running hash of the words before the gap and one of the
words behind it, so a line of n words costs n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A

# One edit keeps four fifths of a line only from so many words on.
LEAST_WORDS = 5
# Up to so many rows of a join side go to every task; beyond it both sides are shuffled.
MOST_BROADCAST = 1_000_000

_PLACE = ("doc_id", "text_key", "line_no")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, text_key, line_no, words)`` of lines with a word."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"),
        F.posexplode(F.split(body, "\n")).alias("line_no", "line"),
    )
    return rows.filter(F.col("line").rlike(A.NOT_SPACE)).select(*_PLACE, A.words(F.col("line")).alias("words"))


def _with_end_keys(lines: DataFrame) -> DataFrame:
    """``(place, line_key, ends)``: keys of the first and the last words, just under half of the shorter line.

    Their number grows in steps, so that a line has the same step as most of its neighbours and one more pair of keys
    where the line of one word less has not.
    """

    def step(m: Column) -> Column:
        half = F.floor(m / 2)
        power = F.pow(F.lit(2.0), F.floor(F.log2(half.cast("double"))))
        return F.when(half >= power * 1.5, F.floor(power * 1.5)).otherwise(power).cast("int")

    def ends(q: Column) -> Column:
        return F.array(
            F.xxhash64(q, F.lit("first"), F.slice("words", 1, q)), F.xxhash64(q, F.lit("last"), F.slice("words", F.col("n") - q + 1, q))
        )

    # In steps of their own, so that each value is computed once and the generated code stays small.
    counted = lines.select(*_PLACE, "words", F.size("words").alias("n"), F.xxhash64("words").alias("line_key"))
    able = F.col("n") >= LEAST_WORDS - 1
    stepped = counted.select("*", F.when(able, step(F.col("n"))).alias("own"), F.when(F.col("n") >= LEAST_WORDS, step(F.col("n") - 1)).alias("less"))
    none = F.array().cast("array<bigint>")
    both = stepped.select(
        "*", F.when(able, ends(F.col("own"))).otherwise(none).alias("a"),
        F.when(F.col("less") != F.col("own"), ends(F.col("less"))).otherwise(none).alias("b"),
    )
    return both.select(*_PLACE, "line_key", F.concat("a", "b").alias("ends"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a join side only where its counted rows stay under the bound."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _words_of(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``(line_key, words)`` for the lines at the places of ``wanted``."""
    per_text = wanted.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("line_no", "line_key")).alias("at"))
    asked = stage(per_text, "asked-lines").withColumnsRenamed({"doc_id": "asked_id", "text_key": "asked_key"})
    rows = asked.agg(F.sum(F.size("at"))).first()[0] or 0
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    found = own.join(_sent(asked, rows), (F.col("text_key") == F.col("asked_key")) & F.col("doc_id").eqNullSafe(F.col("asked_id")))
    lines = found.select(F.split("text", "\n").alias("lines"), "at").select("lines", F.inline("at"))
    return lines.select("line_key", A.words(F.get("lines", F.col("line_no"))).alias("words")).dropDuplicates(["line_key"])


def _variants(lines: DataFrame) -> DataFrame:
    """``(variant, line_key)``: keys of a line with each word deleted, and with nothing deleted at each gap.

    A key is made of the number of remaining words, what stands before the gap and what stands behind it.
    """
    n = F.size("words")
    exploded = lines.select("line_key", n.alias("n"), F.posexplode("words").alias("i", "word")).select(
        "line_key", "n", "i", F.xxhash64("word", "i").alias("ahead"), F.xxhash64("word", F.col("n") - F.col("i")).alias("behind")
    )
    line = Window.partitionBy("line_key")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = exploded.select(
        "line_key", "n", "i", "behind", F.coalesce(F.bit_xor("ahead").over(before), F.lit(0)).alias("head"),
        F.bit_xor("ahead").over(upto).alias("head_too"),
        F.bit_xor("behind").over(line).bitwiseXOR(F.bit_xor("behind").over(upto)).alias("tail"),
    )
    n, i = F.col("n"), F.col("i")
    deleted = F.xxhash64(n - 1, "head", "tail")
    whole = F.xxhash64(n, "head", F.col("tail").bitwiseXOR(F.col("behind")))
    at_end = F.xxhash64(n, "head_too", F.lit(0).cast("long"))
    keys = F.array_compact(F.array(F.when(n >= LEAST_WORDS, deleted), whole, F.when(i == n - 1, at_end)))
    return sums.select("line_key", F.explode(keys).alias("variant"))


def within_one(x: Column, y: Column) -> Column:
    """Whether two word arrays differ by at most one word replaced, added or left out."""
    shorter = F.least(F.size(x), F.size(y))
    longer = F.greatest(F.size(x), F.size(y))

    def equal_run(a: Column, b: Column) -> Column:
        # Arrays of unequal length differ where one ends: zip_with pads with null.
        place = F.array_position(F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False))
        return F.when(place == 0, longer.cast("long")).otherwise(place - 1)

    return (longer - shorter <= 1) & (
        F.least(equal_run(x, y) + equal_run(F.reverse(x), F.reverse(y)), shorter.cast("long")) >= longer - 1
    )


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, line_no, near, first_doc_id, first_line_no)`` of the lines that go, and the earlier line.

    A line goes if an earlier one (smaller id, then line number) has the same words, or is within one word edit of it
    and one of the two has at least five words; it goes also where that earlier line goes for another. Lines without a word stay.
    """
    keyed = stage(_with_end_keys(_lines(docs, doc_id, text)), "lines")
    first = F.min(F.struct(*_PLACE)).alias("first")
    distinct = stage(keyed.groupBy("line_key").agg(first, F.count("*").alias("n")), "distinct-lines")

    ends = keyed.select("line_key", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min("line_key").alias("a"), F.max("line_key").alias("b")).filter("a < b").select("end")
    shared = stage(shared, "shared-ends")
    able = ends.join(_sent(shared, shared.count()), "end").select("line_key").distinct()
    wanted = distinct.join(able, "line_key").select("line_key", "first.*")
    words = stage(_words_of(docs, doc_id, text, wanted), "able-lines")
    variants = stage(_variants(words), "variants")
    met = variants.groupBy("variant").agg(F.min("line_key").alias("a"), F.max("line_key").alias("b")).filter("a < b").select("variant")
    met = stage(met, "met-variants")
    placed = variants.join(_sent(met, met.count()), "variant").join(distinct.select("line_key", "first"), "line_key")
    placed = placed.select("variant", F.struct("first.*", "line_key").alias("line"))
    lead = placed.groupBy("variant").agg(F.min("line").alias("lead"))
    pairs = placed.join(lead, "variant").filter("lead < line").select(F.col("line.line_key").alias("line_key"), "lead").distinct()
    checked = (
        pairs.withColumn("lead_key", F.col("lead.line_key"))
        .join(words.select("line_key", F.col("words").alias("x")), "line_key")
        .join(words.select(F.col("line_key").alias("lead_key"), F.col("words").alias("y")), "lead_key")
        .filter(within_one(F.col("x"), F.col("y")))
    )
    near = checked.groupBy("line_key").agg(F.min("lead").alias("lead"))
    verdicts = distinct.join(near, "line_key", "left").filter("n > 1 or lead is not null").select("line_key", "first", "lead")
    own = F.struct(*_PLACE)
    found = keyed.drop("ends").join(verdicts, "line_key").withColumn("later", F.col("first") < own)
    return found.filter("later or lead is not null").select(
        *_PLACE, (~F.col("later")).alias("near"),
        F.when(F.col("later"), F.col("first.doc_id")).otherwise(F.col("lead.doc_id")).alias("first_doc_id"),
        F.when(F.col("later"), F.col("first.line_no")).otherwise(F.col("lead.line_no")).alias("first_line_no"),
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``kept_text`` (the lines that stay, joined by line feeds), ``n_lines``, ``n_exact`` and ``n_near`` (long).

    ``n_lines`` counts lines with a word; the other two those that go, because an earlier line has the same words or is
    within one edit. See ``repeated_lines``. Every row comes back once with its own columns. Null texts stay null, empty
    texts and lines without a word stay as they are. Rows that agree in id and text are one document, so each of them
    keeps the lines that it is first to have. Earlier columns of the four names are replaced.
    """
    name = A.own_names(docs, "id", "key", "of_key", "gone")
    gone = repeated_lines(docs, doc_id, text).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("line_no", "near")).alias("gone"))
    gone = stage(gone, "gone-lines").withColumnsRenamed({"doc_id": name["id"], "text_key": name["of_key"], "gone": name["gone"]})
    rows = gone.agg(F.sum(F.size(name["gone"]))).first()[0] or 0
    keyed = docs.withColumn(name["key"], F.xxhash64(F.col(f"`{text}`")))
    joined = keyed.join(
        _sent(gone, rows), (keyed[name["key"]] == gone[name["of_key"]]) & keyed[doc_id].eqNullSafe(gone[name["id"]]), "left"
    )
    listed = F.coalesce(F.col(name["gone"]), F.array().cast("array<struct<line_no:int,near:boolean>>"))
    text_column = F.col(f"`{text}`")
    numbers = F.transform(listed, lambda g: g["line_no"])
    # The numbers that stay are found through a hash set, so that a document costs one step for each line.
    kept = A.let(F.split(text_column, "\n"), lambda lines: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers), lambda i: F.get(lines, i)
    ))
    n_near = F.size(F.filter(listed, lambda g: g["near"]))
    return joined.select(
        *[f"`{c}`" for c in docs.columns if c not in ("kept_text", "n_lines", "n_exact", "n_near")],
        F.when(F.size(listed) == 0, text_column).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(A.written_lines(text_column)).cast("long").alias("n_lines"),
        (F.size(listed) - n_near).cast("long").alias("n_exact"), n_near.cast("long").alias("n_near"),
    )
