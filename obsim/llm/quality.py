"""Quality rules: a threshold table compiled into one projection of text ratios.

Every measure is a built-in expression over the row itself: no shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

# Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "on", "be", "by", "this", "are", "was",
    "a", "an", "at", "or", "from", "not",
    "de", "la", "le", "les", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au",
    "est", "il", "elle", "avec", "pas", "plus",
    "der", "die", "das", "und", "ist", "mit", "von", "den", "dem", "nicht", "ein", "eine", "für", "auf", "zu", "im",
    "sich", "als",
    "los", "las", "el", "y", "del", "se", "una", "con", "no", "es", "al", "lo", "por", "su", "para",
)
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` for texts of at least ``min_words`` words; a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


# The threshold table. ``measure`` is SQL over the counts of ``counted``.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words / n_words", 0.04, None, 40),
    Rule("repeated_line_share", "n_dup_lines / n_lines", None, 0.4, 20),
    Rule("capital_share", "n_capitals / word_chars", None, 0.4, 20),
    Rule("exclamations_per_word", "n_exclamations / n_words", None, 0.5, 20),
)


def _repeated_window_words(grams: Column) -> Column:
    """Number of words inside windows that occur at least twice, given the window hashes in text order."""

    def covered(starts: Column) -> Column:
        # Every start covers WINDOW words, cut short where the next start follows sooner.
        return F.aggregate(
            F.sequence(F.lit(0), F.size(starts) - 1),
            F.lit(0).cast("long"),
            lambda total, k: total + F.coalesce(F.least(F.lit(WINDOW), F.get(starts, k + 1) - F.get(starts, k)), F.lit(WINDOW)),
        )

    def repeated_starts(ordered: Column) -> Column:
        twins = F.filter(ordered, lambda g, k: (
            F.coalesce(F.get(ordered, k - 1)["h"] == g["h"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["h"] == g["h"], F.lit(False))
        ))
        return F.sort_array(F.transform(twins, lambda g: g["at"]))

    ordered = F.sort_array(F.transform(grams, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    return F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        A.let(A.let(ordered, repeated_starts), covered),
    ).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules are written over.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``, ``n_stop_words``,
    ``n_capitals`` and ``n_exclamations``, all long. A null or empty text counts zero everywhere. A column of ``docs``
    with one of these names is replaced.
    """
    n = A.own_names(docs, "words", "lines", "grams")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.withColumns({n["words"]: A.words(F.col(f"`{text}`")), n["lines"]: A.written_lines(F.col(f"`{text}`"))})
    w, lines = F.col(n["words"]), F.col(n["lines"])
    grams = F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))
    wide = split.withColumn(n["grams"], grams)
    return wide.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.octet_length(body) - F.octet_length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated_window_words(F.col(n["grams"])),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "n_capitals": (F.octet_length(body) - F.octet_length(F.regexp_replace(body, "[A-Z]+", ""))).cast("long"),
        "n_exclamations": (F.octet_length(body) - F.octet_length(F.regexp_replace(body, "!+", ""))).cast("long"),
    }).drop(*n.values())


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column per rule (true: broken), from the threshold table."""
    out = {}
    for rule in rules:
        value = F.expr(f"try_divide({rule.measure.replace(' / ', ', ')})")
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < F.lit(rule.low))
        if rule.high is not None:
            bad = bad | (value > F.lit(rule.high))
        out[rule.name] = F.coalesce((F.col("n_words") >= rule.min_words) & bad, F.lit(False))
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, ``base_failed``, ``broken_rules`` (names, in table order) and ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated five-word windows. A document is
    kept if neither that nor any rule of the table speaks against it. Rows are judged one by one, so repeated rows and
    null ids are ordinary rows; null and empty texts fail the base rule.
    """
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in compiled(rules).items()]))
    return (
        counted(docs, text)
        .withColumns({"base_failed": failed, "broken_rules": broken})
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that ``judge`` keeps, with the columns of ``docs`` only.

    A row is unpacked from an array that is null for rejected rows. A filter would be pushed below the projection of the
    counts, and so evaluate them once for every mention.
    """
    tag = A.own_names(docs, "row")["row"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(tag), F.col(f"`{text}`").alias("text"))
    return judge(packed, "text", rules).select(F.inline(F.when(F.col("kept"), F.array(F.col(tag)))))
