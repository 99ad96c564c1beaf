"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams: some alternative must have all its trigrams in the
text. The index holds a posting (trigram, text key) for every trigram of the rules' vocabulary that a text contains;
intersecting postings by text key gives the candidates, and only those are verified with the expression itself. A rule
with an alternative that demands no trigram is verified on every text.

Built-in expressions throughout; spans come from splitting a text at the matches.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import arrays as A


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters.

    ``pattern`` must be valid in Java, and ASCII letters match in either case if ``any_case``. ``full`` may give an
    equivalent, faster expression for scanning whole texts where short matches fail anyway.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    full: str | None = None

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.full or self.pattern)


# The rule table; the first three are the base kinds, and order decides between spans with one start.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A maximal run of 32 or more digits is the same match as a run kept for its length.
    Rule("hex", r"[0-9a-f]+", 0, 32, full=r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("urlcred", r"://[A-Za-z0-9._~%-]{1,100}:[A-Za-z0-9._~%!$&*+=-]{1,100}@"),
)
BASE_KINDS = ("assign", "access", "hex")
# More spellings or letters than this are treated as a gap; the query only gets weaker.
MAX_SPELLINGS = 64
MAX_LETTERS = 8


def _spellings(tree) -> list[str]:
    """Texts that any match must contain in order; a line feed stands for a gap of unknown text."""
    out = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            more = [chr(arg)]
        elif op is C.IN and len(arg) <= MAX_LETTERS and all(o is C.LITERAL for o, _ in arg):
            more = [chr(x) for _, x in arg]
        elif op is C.SUBPATTERN:
            more = _spellings(arg[-1])
        elif op is C.BRANCH:
            more = list(itertools.chain.from_iterable(_spellings(x) for x in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            inner = _spellings(sub)
            if (low, high) == (0, 1):
                more = ["", *inner]
            elif low == high and low * len(inner) <= MAX_LETTERS:
                more = ["".join(x) for x in itertools.product(inner, repeat=low)]
            else:
                more = [x + "\n" for x in inner] if low else ["\n"]
        else:
            more = ["\n"]
        if len(out) * len(more) > MAX_SPELLINGS:
            more = ["\n"]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams, one of which every match holds entirely; empty if a match may hold none."""
    found = set()
    for spelling in _spellings(parser.parse(pattern)):
        runs = spelling.lower().split("\n")
        found.add(frozenset(run[i:i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for rule in rules for alternative in trigram_query(rule.pattern) for t in alternative})


def text_key(text: Column) -> Column:
    """The key that index and documents meet on. Texts that share a key share candidates, which costs only time."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings ``(trigram, text_key)``, each once, for the trigrams of the rules' vocabulary; equal texts share theirs."""
    body = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    held = A.let(body, lambda t: F.filter(F.array(*[F.lit(g) for g in vocabulary(rules)]), lambda g: F.contains(t, g)))
    return (
        docs.select(text_key(F.col(f"`{text}`")).alias("text_key"), F.explode(held).alias("trigram"))
        .distinct()
        .select("trigram", "text_key")
    )


def candidates(spark: SparkSession, index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(text_key, kinds)``: the rules whose Boolean query the postings of a text satisfy."""
    wanted = [
        (rule.kind, n, trigram, len(alternative))
        for rule in rules for n, alternative in enumerate(trigram_query(rule.pattern)) for trigram in alternative
    ]
    # A few hundred rows at most, from the rule table.
    design = F.broadcast(spark.createDataFrame(wanted, "kind string, alternative int, trigram string, need int"))
    return (
        index.join(design, "trigram")
        .groupBy("text_key", "kind", "alternative", "need").agg(F.count("*").alias("held"))
        .filter("held = need")
        .groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))
    )


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of ``(start, rank, end, kind)``: code points, end exclusive, of the matches that are long enough."""

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    pieces = F.struct(
        F.split(text, rule.java, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)).alias("judged"),
    )

    def fold(p: Column) -> Column:
        def step(so_far: Column, k: Column) -> Column:
            start = so_far["at"] + F.length(F.get(p["between"], k))
            end = start + F.length(F.get(p["whole"], k))
            found = F.array(F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")
            ))
            good = F.length(F.get(p["judged"], k)) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(so_far["found"], found)).otherwise(so_far["found"]).alias("found"))

        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        many = F.sequence(F.lit(0), F.size(p["whole"]) - 1)
        return F.when(F.size(p["whole"]) > 0, F.aggregate(many, start, step)["found"]).otherwise(empty)

    return F.when(F.regexp_like(text, F.lit(rule.java)), A.let(pieces, fold)).otherwise(empty)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secret_spans``: all spans of all rules by start, then rule order, as ``(start, rank, end, kind)``.

    Every row of ``docs`` comes back once with its own columns, whatever they hold; null and empty texts have no spans.
    The index is staged in the shared folder, so a lost executor costs no second scan of the texts.
    """
    n = A.own_names(docs, "key", "kinds", "found")
    index = stage(build_index(docs, text, rules), "trigram-index")
    found = candidates(docs.sparkSession, index, rules).withColumnsRenamed({"text_key": n["key"], "kinds": n["kinds"]})
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumn(n["key"], text_key(F.col(f"`{text}`"))).join(found, n["key"], "left")
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = spans_of(body, rule, rank)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(F.col(n["kinds"]), rule.kind), spans).otherwise(nothing)
        parts.append(spans)
    out = keyed.withColumn("secret_spans", F.sort_array(F.concat(*parts)))
    return out.select(*[f"`{c}`" for c in docs.columns if c != "secret_spans"], "secret_spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
