"""Source divergence, exact dedup and vector codes against plain reference versions, also on awkward input."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from obsim.llm import divergence, exact_dedup, vector_codes
from tests.llm import helpers as H

# ---------------------------------------------------------------- exact dedup


def _copies(rows):
    """(doc_id, text) rows to sorted (doc_id, keep_id, group_size, text_sha256), and how many stay."""
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    out = [(d, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("fan, run_rows", [(16, 2_000_000), (2, 3), (3, 5)])
def test_exact_dedup_matches_brute_force(spark, fan, run_rows):
    texts = H.awkward_texts() + ["hot text"] * 150 + ["Hot text", "hot text ", "hot\ttext"]
    docs = H.table(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = exact_dedup.mark_copies(docs.repartition(7), fan=fan, run_rows=run_rows).toPandas()
    wanted, groups = _copies(rows)
    none = lambda x: None if x is None or x != x else int(x)
    got = [(none(r.doc_id), none(r.keep_id), r.group_size, r.text_sha256) for r in out.itertuples()]
    assert sorted(got, key=str) == wanted
    stay = out[out.kept]
    assert len(stay) == groups and stay.text_sha256.is_unique
    assert [none(x) for x in stay.doc_id] == [none(x) for x in stay.keep_id]
    assert set(docs.columns) <= set(out.columns)


def test_exact_dedup_keeps_rows_whole(spark):
    rows = [(1, "a", 5), (1, "a", 6), (2, None, 1), (3, "", 2), (None, "b", 3), (None, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = exact_dedup.without_copies(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 3 and set(got) <= set(rows) and (3, "", 2) in got
    clash = spark.createDataFrame([(1, "a", 1, 2, 3)], "doc_id long, text string, digest int, __row int, group_size int")
    assert exact_dedup.mark_copies(clash).columns == ["doc_id", "text", "digest", "__row", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_dedup.mark_copies(H.empty(spark)).count() == 0


def test_entries_are_folded_across_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((bytes([rng.randint(0, 5)]), rng.randint(0, 1), -i, 0, rng.randint(1, 3), 0) for i in range(200))
    names = [*exact_dedup._ENTRY, "slot"]
    kinds = (pa.binary(), *[pa.int64()] * 5)
    schema = pa.schema([pa.field(c, k, nullable=c != "size") for c, k in zip(names, kinds)])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + n]), kinds)], schema=schema) for at, n in ((0, 1), (1, 60), (61, 1), (62, 138))]
    out = [r for b in exact_dedup.fold(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    wanted = {}
    for digest, length, own, row, size, slot in rows:
        first = wanted.setdefault((digest, length), [own, 0])
        first[1] += size
    assert [(d, n, i, s) for d, n, i, _, s, _ in out] == [(*k, *v) for k, v in sorted(wanted.items())]


def test_tree_shape():
    assert exact_dedup.tree(10, 51) == (8, 2) and exact_dedup.tree(0, 1) == (2, 1)
    for rows in (1, 10**6, 10**9, 3 * 10**10):
        fan, rounds = exact_dedup.tree(rows, 200)
        assert fan <= exact_dedup.FAN and fan**rounds >= max(200, math.ceil(rows / exact_dedup.RUN_ROWS))


# ---------------------------------------------------------------- source divergence


def _audit(rows, least_docs, ranks):
    """(text, lang, source) rows to the set of result rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        counts.update((lang, source, t) for t in found)
        docs.update({(lang, t) for t in found})
    out = []
    for lang, sources in groups.items():
        kept = [t for (own, t), n in docs.items() if own == lang and n >= least_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[u][t]) for t in kept), u.encode()) for u in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


def _sources(seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(160):
        words = [rng.choice(["the", "The", "été", "ÉTÉ", "straße", "x1y", "日本", "a_b", "don't"] + H.WORDS) for _ in range(rng.randint(0, 40))]
        rows.append((" ".join(words), rng.choice(["en", "de", None]), f"s{rng.randint(0, 4)}" if k % 9 else None))
    rows += [(None, "en", "null only"), ("", "alone", "x"), ("12 3 !!", "en", "s1"), ("word " * 2_000, "en", "s0")]
    return rows + [("hot word " * 20, "en", "s0")] * 80


@pytest.mark.parametrize("least, ranks, block, pairs, side", [(30, 50, divergence.BLOCK_BYTES, 1_000_000, 512), (5, 3, 700, 4, 2), (1, 50, 1, 1, 1)])
def test_divergence_matches_brute_force(spark, monkeypatch, least, ranks, block, pairs, side):
    monkeypatch.setattr(divergence, "_SIDE", side)
    rows = _sources()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, no long, `__x` string").repartition(5)
    out = divergence.audit(docs, least_docs=least, ranks=ranks, block=block, pairs=pairs)
    assert sorted(tuple(r) for r in out.collect()) == _audit(rows, least, ranks)
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_terms_do_not_depend_on_the_piece():
    body = ("Ein Käse, zwei\tÄpfel\x00drei " * 30).encode()
    whole = [t for part in divergence.terms(body) for t in part]
    for piece in (1, 3, 17, 1000):
        assert [t for part in divergence.terms(body, piece) for t in part] == whole
    assert list(divergence.terms(b"")) == []


@pytest.mark.parametrize("most", [1, 50, 400, 10**6])
def test_runs_of_any_block_add_up_to_the_same_postings(most):
    import pyarrow as pa

    rows = [tuple(x or "" for x in r) for r in _sources()][:150] + [("", "xx", "no terms"), ("1 2", "xx", "no terms")]
    whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 0)], ["lang", "source", "text"])
    wanted, docs = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        found = [t.decode() for part in divergence.terms(text.encode()) for t in part]
        wanted.update((lang, source, t) for t in found)
        docs.update({(lang, source, t) for t in found})
    got, held, groups = collections.Counter(), collections.Counter(), set()
    for run in divergence.block_postings(most)(iter([whole.slice(0, 3), whole.slice(3, 0), whole.slice(3)])):
        names = run.column("term").to_pylist()
        assert names == sorted(names)
        for lang, term, source, n, d in zip(*(c.to_pylist() for c in run.columns)):
            if term:
                got[lang, source, term.decode()] += n
                held[lang, source, term.decode()] += d
            groups.add((lang, source))
    assert got == wanted and held == docs and groups == {r[1:] for r in rows}


def test_pair_corrections_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_SIDE", 3)
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        no = sorted(rng.sample(range(12), rng.randint(2, 10)))
        rows.append({"lang": rng.choice("ab"), "postings": [{"no": n, "p": rng.randint(5, 90), "z": n + 1} for n in no]})
    kind = pa.list_(pa.struct([("no", pa.int64()), ("p", pa.int64()), ("z", pa.int64())]))
    schema = pa.schema([("lang", pa.string()), ("postings", kind)])
    wanted = collections.Counter()
    for r in rows:
        for x, y in itertools.combinations(r["postings"], 2):
            p, z, u, v = x["p"], x["z"], y["p"], y["z"]
            wanted[r["lang"], x["no"], y["no"]] += abs(p - u) - abs(p - v) - abs(z - u) + abs(z - v)
    for most in (10**6, 9, 1):
        got = collections.Counter()
        batches = [pa.RecordBatch.from_pylist(rows[:15], schema), pa.RecordBatch.from_pylist(rows[15:], schema)]
        for batch in divergence.pair_corrections(most)(iter(batches)):
            for lang, a, b, value in zip(*(c.to_pylist() for c in batch.columns)):
                got[lang, a, b] += value
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in wanted.items() if v}


def test_divergence_of_large_counts_and_empty_tables(spark):
    from pyspark.sql import functions as F

    cases = [(0, 10, 3), (4 * 10**12, 9 * 10**12, 10**8), (7, 7, 1), (123_456_789_012, 987_654_321_098, 54_321)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in got.collect())
    assert divergence.audit(H.empty(spark)).count() == 0
    one = spark.createDataFrame([("a b", None, None)], "text string, lang string, source string")
    assert divergence.audit(one).count() == 0


# ---------------------------------------------------------------- vector codes


def _codes(rows, parts, entries, rounds):
    """(vec_id, whole numbers) in seed order to {vec_id: (code, error)} and the codebooks, with plain integers."""
    width = len(rows[0][1]) // parts
    out, books = collections.defaultdict(lambda: ([], 0)), []
    for k in range(parts):
        own = [(i, tuple(w[k * width:(k + 1) * width])) for i, w in rows]
        book = [w for _, w in own[:entries]]

        def closest(w):
            return min((sum((x - y) ** 2 for x, y in zip(w, e)), n) for n, e in enumerate(book))

        for _ in range(rounds):
            members = collections.defaultdict(list)
            for _, w in own:
                members[closest(w)[1]].append(w)
            for n, m in members.items():
                book[n] = tuple(sum(c) // len(m) for c in zip(*m))
        for i, w in own:
            d, n = closest(w)
            out[i] = (out[i][0] + [n], out[i][1] + d)
        books.append(book)
    return dict(out), books


def _vectors(seed=2, n=90, dim=8):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-1.5, 0.25, 2.0]) + rng.random() for _ in range(dim)], rng.choice([0, 1, None])) for k in range(n)]
    rows += [(200 + k, rows[3][1], 7) for k in range(70)]  # one vector is over a third of all
    bad = [(-5, None, 1), (-4, [], 1), (-3, [1.0] * 7 + [float("nan")], 1), (-2, [1.0] * 7 + [None], None), (-1, [float("-inf")] * dim, 1)]
    return rows, bad


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 4), (2, 256, 3), (1, 5, 0), (8, 3, 2)])
def test_codes_match_brute_force(spark, parts, entries, rounds):
    good, bad = _vectors()
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int").repartition(6)
    codes, books = vector_codes.compress(table, parts=parts, entries=entries, rounds=rounds)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in good]
    wanted, plain = _codes(whole, parts, entries, rounds)
    got = vector_codes.label_errors(codes).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == wanted and len(got) == len(good)
    assert [b.tolist() for b in books] == [[list(e) for e in b] for b in plain]
    sums = collections.Counter()
    for i, _, label in good:
        sums[label] += wanted[i][1]
    assert all(r.label_error == sums[r.label] for r in got)


def test_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<double>, label string, row int, part int"
    codes, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert codes.count() == 0 and books == [] and codes.columns == ["vec_id", "label", "code", "error"]
    same = [(None, [0.5] * 4, None, 1, 1), (1, [0.25] * 4, "a", 1, 1), (1, [0.25] * 4, "a", 1, 1), (0, [1.0] * 4, None, 1, 1), (2, [1.0] * 3, "a", 1, 1)]
    codes, books = vector_codes.compress(spark.createDataFrame(same, schema), entries=3)
    # The second of two equal seeds takes over when the first moves towards the row without an id.
    assert [b.ravel().tolist() for b in books] == [[1024, 512, 256]] * 4
    assert sorted((str(r.vec_id), r.code[0], r.error) for r in codes.collect()) == [("0", 0, 0), ("1", 2, 0), ("1", 2, 0), ("None", 1, 0)]
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, "a", 1, 1)], schema))[0].count() == 0
    with pytest.raises(Exception, match="exceeds"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 4, "a", 1, 1)], schema))


def test_nearest_is_exact_for_large_numbers():
    rng = np.random.default_rng(4)
    for most in (1 << 10, vector_codes.LARGEST):
        rows, book = rng.integers(-most, most, (200, 16)), rng.integers(-most, most, (30, 16))
        book[7] = book[3]
        place, distance = vector_codes.nearest(rows, book)
        exact = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(r, e)), n) for n, e in enumerate(book)) for r in rows]
        assert [(int(d), int(n)) for d, n in zip(distance, place)] == exact


def test_only_parts_that_change_entry_are_shuffled(spark):
    good, _ = _vectors(n=60)
    table = spark.createDataFrame(good, "vec_id long, embedding array<double>, label int")
    seen = []
    first = vector_codes.assign
    try:
        vector_codes.assign = lambda parts, books, label: seen.append(first(parts, books, label)) or seen[-1]
        codes, books = vector_codes.compress(table, entries=8)
    finally:
        vector_codes.assign = first
    for assigned in seen[1:]:
        stay = vector_codes.migrated(assigned.filter("entry = next"))
        assert "Exchange" not in stay._jdf.queryExecution().toString()
        assert assigned.filter("entry <> next").count() < assigned.count() / 2
    back = vector_codes.reconstructed(codes, books).toPandas().set_index("vec_id")
    error = {i: sum((math.floor(1024 * x) - math.floor(1024 * y)) ** 2 for x, y in zip(v, back.loc[i, "vector"])) for i, v, _ in good}
    assert error == back.error.to_dict()
