"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pytest

from obsim.llm import decontam, exact_dedup, jaccard, line_dedup, mixing
from tests.llm import helpers as H


def test_a_small_source_does_not_end_the_mix(spark):
    rng = random.Random(11)
    rows = [(k, H.prose(rng, 60), "a" if k % 3 else "b") for k in range(600)] + [(600, "once", "c"), (601, "null", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = mixing.mixed_corpus(docs, block_bytes=64, frame=50).collect()
    assert sorted(r.doc_id for r in kept) == list(range(602))
    out = mixing.mix(docs, block_bytes=64, frame=50).toPandas().sort_values("mix_slot")
    assert out.in_mix.mean() > 0.8
    # Tempered weights of the two sources that last, at every prefix of the part where all have blocks.
    size = {s: sum(len(t) + 1 for _, t, x in rows if x == s) ** 0.9 for s in ("a", "b", "c", None)}
    blocks = out[out.in_mix].drop_duplicates("mix_slot").source.tolist()
    for n in range(1, len(blocks)):
        for s in ("a", "b", "c"):
            assert abs(blocks[:n].count(s) - n * size[s] / sum(size.values())) < 3
    for r in out[out.in_mix].itertuples():
        w = size[r.source if isinstance(r.source, str) else None] / sum(size.values())
        assert abs(r.mix_block - w * r.mix_slot) < 1 and abs(r.mix_block + 1 - w * (r.mix_slot + 1)) < 1


def _found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontam.leaks(H.table(spark, texts, list(range(len(texts)))), bench).toPandas()
    return {(r.doc_id, r.item_id): bool(r.reparameterised) for r in out.itertuples()}


A = "the farmer sells 3 apples at noon and the baker then buys 3 pears from the farmer in the evening"
B = A.replace("3 apples", "4 apples").replace("3 pears", "7 pears")


def test_items_of_one_template_are_judged_by_their_own_values(spark):
    # A copy with a mistyped repeat keeps all windows but those that hold it.
    slip = A.replace("3 pears", "8 pears")
    got = _found(spark, [A, B], [f"so {B} yes", f"so {A} yes", f"so {slip} no"])
    assert {k for k, changed in got.items() if not changed} == {(0, 1), (1, 0)}
    assert got[1, 1] and got[2, 0]


@pytest.mark.parametrize("bound", [decontam.MOST_BROADCAST, 0])
def test_lightly_edited_items_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "MOST_BROADCAST", bound)
    words = [f"w{chr(97 + k)}x" for k in range(20)]

    def edited(n, *places):
        return " ".join(["pre", "fix", *("other" if k in places else w for k, w in enumerate(words[:n])), "post"])

    cut = " ".join(words[:7] + words[8:15])
    added = " ".join(words[:7] + ["added"] + words[7:15])
    texts = [edited(15, 7), edited(15, 4, 9), edited(20, 6, 13), cut, added, " ".join(words[:7]), edited(15, 2, 5, 8, 11)]
    items = [" ".join(words[:15]), " ".join(words)]
    got = {d for d, _ in _found(spark, items, texts)}
    assert got == {0, 1, 2, 3, 4}


def test_short_dense_and_lower_case_items_are_found(spark):
    short = "never trust a talking fox"
    dense = "1 2 3 5 8 13 21 34 55 89 144 233"
    name = "when did Alice and Robert first meet the old captain Morgan near the harbour of Lisbon in spring"
    texts = ["he said never trust a talking fox and left the room at once", f"the series {dense} goes on", f"so {name.lower()} then",
             f"SO {name.upper()} THEN", "1 2 3 4 5 6 7 9 10 11 12 13", "never trust a talking bird and leave the room at once", "TITLE"]
    assert set(_found(spark, [short, dense, name, "Title"], texts)) == {(0, 0), (1, 1), (2, 2), (3, 2), (6, 3)}


@pytest.mark.parametrize("block", [512, 4])
def test_links_are_all_similar_pairs_of_a_group(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(4)
    origin = H.prose(rng, 120).split()
    texts = [H.prose(rng, 40), *[H.prose(rng, 90)] * 2]
    texts.append(texts[1] + " more")
    for _ in range(20):
        words = list(origin)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"edit{rng.randint(0, 999)}"
        texts.append(" ".join(words))
    out = jaccard.near_duplicates(H.table(spark, texts, list(range(len(texts))))).orderBy("doc_id").toPandas()
    sets = [H.shingles(t) for t in texts]
    wanted = [len({y for y in sets if y != x and len(x & y) >= 0.8 * len(x | y)}) for x in sets]
    assert out.n_links.tolist() == wanted


def test_any_further_columns_may_come_along(spark):
    names = ["of", "each", "per", "sourceo", "pieceo", "keyo", "of_key", "of_source", "row", "digest", "winner", "size"]
    extra = ", ".join(f"`__{n}` int" for n in names)
    rows = [(k, "one two three\nfour five six", f"s{k % 2}", *range(len(names))) for k in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}")
    for out in (mixing.mix(docs, block_bytes=16, frame=20), line_dedup.without_repeated_lines(docs), exact_dedup.mark_copies(docs)):
        assert set(docs.columns) <= set(out.columns) and out.count() == 6
    assert mixing.mixed_corpus(docs, block_bytes=16, frame=20).columns == docs.columns and exact_dedup.without_copies(docs).count() == 1


def test_slots_of_the_pipeline_follow_the_order_of_the_mix_as_written(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    order = list(range(200))
    rng.shuffle(order)
    docs = spark.createDataFrame([(d, f"w{d} " * rng.randint(1, 30), i) for i, d in enumerate(order)], "doc_id long, text string, i long")
    docs.repartitionByRange(4, "i").sortWithinPartitions("i").write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.sharded(spark, spark.read.parquet(str(tmp_path / "mixed")), "").toPandas()
    assert sorted(out.doc_id) == list(range(200))
    for _, own in out.sort_values("slot").groupby("shard"):
        assert own.slot.tolist() == list(range(len(own))) and own.i.is_monotonic_increasing


def test_mixing_deals_texts_out_for_numbering_and_for_slots_only(spark):
    """Without broadcasts too, rows stay where their piece is numbered when they get their slots."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, H.prose(rng, 20), "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(s, None) for s in settings]
    try:
        for s in settings:
            spark.conf.set(s, -1)
        out = mixing.mixed_corpus(docs, block_bytes=64, frame=50)
        plan = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines()]
        assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    finally:
        for s, value in zip(settings, before):
            spark.conf.unset(s) if value is None else spark.conf.set(s, value)
    window = next(k for k, line in enumerate(plan) if " Window " in line or "- Window" in line)
    above = [line for line in plan[:window] if "Exchange" in line]
    assert len(above) == 1 and "rangepartitioning" in above[0]


def test_words_of_letters_and_digits_skip_the_expressions(monkeypatch):
    """Plain words are told without either expression; others as before."""
    asked = []

    class Edge:
        @staticmethod
        def sub(_, word):
            asked.append(word)
            return word.strip("(),.")

    monkeypatch.setattr(decontam, "_EDGE", Edge)
    codes, kinds, _ = decontam.Tokens().of("the (river) took twelve 12 km and x² of Stone, then")
    assert asked == ["(river)", "Stone,"]
    assert kinds.tolist() == [0, 0, 0, 1, 1, 2, 0, 0, 0, 3, 0]


def test_windows_are_found_among_those_with_equal_leading_bits():
    wanted = np.sort(np.array([5, (7 << 44) + 3, (7 << 44) + 9, (1 << 64) - 1], np.uint64))
    found = np.array([5, 6, (7 << 44) + 4, (7 << 44) + 9, 1 << 63, (1 << 64) - 1], np.uint64)
    hit, place = decontam.Known._places(wanted, decontam.Known._heads(wanted), found)
    assert hit.tolist() == [True, False, False, True, False, True]
    assert (wanted[place[hit]] == found[hit]).all()
    empty = np.empty(0, np.uint64)
    assert not decontam.Known._places(empty, decontam.Known._heads(empty), found)[0].any()
