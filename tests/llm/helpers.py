"""Small awkward tables and plain reference versions for the operator tests."""

from __future__ import annotations

import itertools
import random

WORDS = ["the", "of", "river", "stone", "and", "seven", "lantern", "walks", "blue", "over", "paper", "slow", "a", "bird"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key long, `__key` string, shard int, line_no int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def awkward_texts(seed: int = 1) -> list[str | None]:
    """Nulls, blanks, one long text, copies, near copies, shared passages and ties."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(10)]
    out: list[str | None] = [None, None, "", "   ", "\n\n", "one", "one", prose(rng, 9_000)]
    out += base + base[:3] * 4
    for text in base[:6]:
        words = text.split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    passage = prose(rng, 70)
    out += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    out.append("word " * 300)
    return out


def table(spark, texts, ids=None):
    """Documents with columns whose names clash with work columns; ids repeat and are null in places."""
    rows = []
    for k, text in enumerate(texts):
        doc_id = ids[k] if ids else (None if k % 17 == 16 else k // 2 if k % 11 == 10 else k)
        rows.append((doc_id, text, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, 7, "x", 3, 1))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = (text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1)))


def near_groups(texts, similarity: float = 0.8) -> list[int]:
    """For each text the first of its group of similar texts, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]
