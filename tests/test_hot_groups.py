"""Order-dependent and spatial operators on fixtures where one group holds most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsim.operators import aggregates, ordered, quantiles, relational, sampling, series, shape, spatial


def skewed(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    return pd.DataFrame({
        "k": key, "t": rng.integers(0, n // 3, n), "id": np.arange(n), "v": rng.normal(size=n).round(3),
    })


def test_number_rows_is_consecutive(spark):
    pdf = skewed()
    got = ordered.number_rows(spark.createDataFrame(pdf), ["k", "t", "id"], "no").toPandas()
    want = pdf.sort_values(["k", "t", "id"]).id.tolist()
    assert got.sort_values("no").id.tolist() == want
    assert sorted(got.no) == list(range(1, len(pdf) + 1))


def test_number_rows_with_one_value_everywhere(spark):
    df = spark.range(1000).withColumn("same", F.lit(7))
    got = ordered.number_rows(df, ["same", "id"], "no", start=0)
    assert got.filter("no = id").count() == 1000


def test_a_hot_key_spreads_over_partitions(spark):
    staged = ordered.sorted_stage(spark.createDataFrame(skewed(20000)), ["k", "t", "id"], parts=8)
    sizes = [r["count"] for r in staged.filter("k = 0").groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20000 / 4


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, inclusive):
    pdf = skewed()
    pdf.loc[pdf.id % 3 == 0, "v"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ordered.running(sdf, ["k"], ["t", "id"], {
        "lo": ("min", "v"), "hi": ("max", "v"), "total": ("sum", "v"), "n": ("count", "v"), "seen": ("last", "v"),
    }, inclusive).toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    ref = pdf.sort_values(["k", "t", "id"]).reset_index(drop=True)
    shift = (lambda s: s) if inclusive else (lambda s: s.shift())
    by = ref.groupby("k").v
    for name, col in {
        "lo": by.transform(lambda s: shift(s.cummin().ffill())),
        "hi": by.transform(lambda s: shift(s.cummax().ffill())),
        "seen": by.transform(lambda s: shift(s.ffill())),
    }.items():
        assert np.allclose(got[name].astype(float), col, equal_nan=True), name
    n = by.transform(lambda s: shift(s.notna().cumsum()).fillna(0))
    assert (got.n == n).all()
    total = by.transform(lambda s: shift(s.fillna(0).cumsum())).where(n > 0)
    assert np.allclose(got.total.astype(float), total, equal_nan=True)


def test_previous_row_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 7.0)], "k int, i int, v double")
    got = {r.i: r.prev_v for r in ordered.previous(df, ["k"], ["i"], ["v"]).collect()}
    assert got == {1: None, 2: 5.0, 3: None}


@pytest.mark.parametrize("task_values, most_cuts, rounds", [(10, 8, 3), (2, 2, 7), (500, 8, 1), (100_000, 8, 0)])
def test_exact_quantiles(spark, monkeypatch, task_values, most_cuts, rounds):
    pdf = skewed(4000)
    pdf.loc[pdf.id % 5 == 0, "v"] = 0.25  # a hot value
    pdf.loc[pdf.id % 977 == 0, "v"] = 1e300  # far from all others
    pdf["k"] = pdf.k.astype("object").where(pdf.id % 11 != 0, None)
    sdf = spark.createDataFrame(pdf, "k int, t long, id long, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    ran, narrow, sorted_rows = [], quantiles._narrowed, []
    monkeypatch.setattr(quantiles, "_narrowed", lambda counts, large, g, cuts: ran.append(cuts) or narrow(counts, large, g, cuts))
    inside = quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda *a: sorted_rows.append(inside(*a)) or sorted_rows[-1])
    got = {r.k: r.q for r in quantiles.exact_quantiles(sdf, ["k"], {"q": "v"}, probs, task_values, most_cuts).collect()}
    for k, part in pdf.groupby("k", dropna=False):
        want = np.quantile(part.v, probs)
        assert np.allclose(got[None if pd.isna(k) else int(k)], want), k
    assert len(ran) >= rounds and (len(ran) > 0) == (rounds > 0) and all(c <= most_cuts for c in ran)
    # No slice that is ranked holds more values than a task is meant to sort.
    assert sorted_rows[-1].groupBy("k", "_m", "_first").count().agg({"count": "max"}).first()[0] <= task_values


def test_medians_of_days_are_bounded(spark):
    df = spark.createDataFrame([(1, 3.0, 0.1), (1, 5.0, 0.7), (1, None, 9.5), (1, float("nan"), 0.2)], "k int, day double, x double")
    assert df.agg(aggregates.small_domain_median("day").alias("m")).first().m == 4.0
    for bad in (F.col("x"), F.col("day") + 5_000):
        with pytest.raises(Exception, match="not whole days"):
            df.agg(aggregates.small_domain_median(bad)).collect()
    kept = relational.quantile_filter(df, ["x"], 0.25, 0.75, ["k"], continuous=True)
    assert sorted(r.x for r in kept.collect()) == [0.2, 0.7]


def test_exact_quantiles_skip_nan_and_empty(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, None)], "k int, v double")
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, ["k"], {"q": "v"}, [0.5]).collect()}
    assert got == {1: [2.0]}


def test_interpolation_paths_agree_with_numpy(spark, monkeypatch):
    rng = random.Random(3)
    kx = sorted({round(rng.random() ** 6 * 100, 4) for _ in range(150)})  # clustered near zero
    ky = [rng.random() for _ in kx]
    xs = [rng.uniform(-5, 105) for _ in range(300)] + kx[:40] + [kx[0], kx[-1]]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    knots = spark.createDataFrame(list(zip(kx, ky)), "kx double, ky double")
    want = np.interp(xs, kx, ky)
    for limit in (1, 10_000):
        monkeypatch.setattr(series, "CELL_KNOTS", limit)
        rows = series.interpolate(df, "x", knots, "kx", "ky", "y").orderBy("i").collect()
        assert len(rows) == len(xs)
        assert np.allclose([r.y for r in rows], want)


def test_interpolation_within_keys(spark, monkeypatch):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (2, 0.5, 3.0)], "k int, kx double, ky double")
    df = spark.createDataFrame([(1, 0.25), (1, 2.0), (2, 9.0), (3, 0.0)], "k int, x double")
    want = {(1, 0.25): 2.5, (1, 2.0): 10.0, (2, 9.0): 3.0, (3, 0.0): None}
    for limit in (1, 64):
        monkeypatch.setattr(series, "CELL_KNOTS", limit)
        rows = series.interpolate_within(df, "x", knots, ["k"], "kx", "ky", "y").collect()
        assert {(r.k, r.x): r.y for r in rows} == want


@pytest.mark.parametrize("ties", ["first", "all"])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_against_brute_force(spark, ties, seed):
    rng = np.random.default_rng(seed)
    # Half of the sites crowd one spot; copies and a far outlier are included.
    sites = np.vstack([rng.normal([3, 3], 0.01, (150, 2)), rng.uniform(0, 10, (150, 2)), [[90, 90]], [[3, 3]] * 20])
    pts = np.vstack([rng.normal([3, 3], 0.02, (150, 2)), rng.uniform(-5, 15, (150, 2)), [[60, 60]]])
    # Binary fractions keep equal distances exactly equal.
    sites, pts = np.round(sites * 1024) / 1024, np.round(pts * 1024) / 1024
    right = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(sites)], "s int, x double, y double")
    left = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(pts)], "p int, px double, py double")
    got = spatial.nearest(left, right, "px", "py", "x", "y", "s", ties=ties).toPandas()
    d = ((pts[:, None, :] - sites[None]) ** 2).sum(-1)
    want = []
    for i, row in enumerate(d):
        ids = np.flatnonzero(row == row.min())
        want += [(i, int(j)) for j in (ids if ties == "all" else ids[:1])]
    assert sorted(zip(got.p, got.nearest_id)) == want


def test_nearest_per_year_and_without_sites(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0)], "p int, px double, py double")
    right = spark.createDataFrame([(2000, 7, 0.0, 1.0), (2000, 8, 5.0, 4.0), (2001, 9, 9.0, 9.0)], "year int, s int, x double, y double")
    got = spatial.nearest(left, right, "px", "py", "x", "y", "s", by=["year"]).collect()
    assert {(r.p, r.year): r.nearest_id for r in got if r.p != 3} == {(1, 2000): 7, (2, 2000): 8, (1, 2001): 9, (2, 2001): 9}
    assert [r.nearest_id for r in got if r.p == 3] == [None]
    none = spatial.nearest(left, right.limit(0), "px", "py", "x", "y", "s")
    assert none.filter("nearest_id IS NULL").count() == 3


def test_points_on_a_shared_border_match_twice(spark):
    def ring(x1, x2):
        return [(x1, 0.0), (x2, 0.0), (x2, 1.0), (x1, 1.0)]

    polys = spark.createDataFrame([("a", ring(0.0, 1.0)), ("b", ring(1.0, 2.0))], "name string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 5.0, 5.0)], "p int, x double, y double")
    got = sorted((r.p, r.name) for r in spatial.points_in_polygons(pts, polys, "x", "y").collect() if r.name)
    assert got == [(1, "a"), (2, "a"), (2, "b")]
    left = spatial.points_in_polygons(pts, polys, "x", "y", how="left")
    assert left.filter("name IS NULL").count() == 1


def test_concave_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    polys = spark.createDataFrame([("v", ring)], "name string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 0.5, 2.0)], "p int, x double, y double")
    got = {r.p for r in spatial.points_in_polygons(pts, polys, "x", "y", how="inner").collect()}
    assert got == {1, 3}


def test_balanced_buckets_equal_the_range_rule(spark):
    keys = list(range(0, 103, 1))
    df = spark.createDataFrame([(k,) for k in keys for _ in range(k % 4 + 1)], "k int")
    got = {(r.k, r.bucket) for r in sampling.balanced_buckets(df, "k", 8).distinct().collect()}
    cuts = np.linspace(0, len(keys), 9).astype(int)
    want = {(keys[i], b) for b in range(8) for i in range(cuts[b], cuts[b + 1])}
    assert got == want


@pytest.mark.parametrize("n", [1, 7, 50, 500])
def test_evenly_spaced_keys(spark, n):
    keys = [k * 3 for k in range(101)]
    got = sorted(r.k for r in sampling.evenly_spaced_keys(spark.createDataFrame([(k,) for k in keys], "k int"), "k", n).collect())
    want = keys if n >= len(keys) else sorted({keys[i] for i in np.linspace(0, len(keys) - 1, n).astype(int)})
    assert got == want


def test_even_ranges():
    assert sampling.even_ranges(1, 10, 3) == [(1, 3), (4, 6), (7, 10)]
    assert sampling.even_ranges(1, 2, 5) == [(1, 1), (2, 2)]


def test_truncate_keeps_uncrossed_series(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 2.0), (1, 3, 2.1), (2, 1, 0.1), (2, 2, 1.9)], "k int, t int, s double")
    got = sorted((r.k, r.t) for r in relational.truncate_at(df, ["k"], ["t"], F.col("s") >= 2).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


def reference_shape(g):
    """Plain single-season restatement of the shape definitions."""
    g = g.sort_values("date").reset_index(drop=True)
    doy = g.date.dt.dayofyear.astype(float)
    drops = np.flatnonzero(np.diff(doy) < 0)
    day = doy + (np.arange(len(doy)) > drops[0]) * 365 if len(drops) else doy

    def slope(mask, v):
        x, y = day[mask], v[mask]
        return np.polyfit(x, y, 1)[0] if len(x) >= 3 and x.max() > x.min() else None

    out = {}
    for name, v in (("obs", g.obs), ("sim", g.sim)):
        top = int(v.idxmax())
        high = day[v >= 0.8 * v[top]]
        out |= {
            f"{name}_peak": v[top], f"{name}_peak_doy": doy[top], f"{name}_peak_stage": g.stage[top],
            f"{name}_rise": slope((g.stage >= 0.2) & (g.stage <= 1.0), v), f"{name}_decline": slope(g.index > top, v),
            f"{name}_plateau_days": high.max() - high.min() if len(high) >= 2 else 0.0,
            f"{name}_early": v[g.stage <= 0.3].mean() if (g.stage <= 0.3).any() else None,
        }
    return out


def test_season_shape_against_reference(spark):
    rng = np.random.default_rng(5)
    rows = []
    for loc in range(6):
        n = 40 if loc == 0 else int(rng.integers(4, 25))
        start = pd.Timestamp("2001-10-01") if loc % 2 == 0 else pd.Timestamp("2001-03-01")
        days = np.sort(rng.choice(500 if loc == 0 else 280, n, replace=False))
        for d in days:
            rows.append((loc, 2002, (start + pd.Timedelta(days=int(d))).date(), d / 140, round(float(rng.random() * 5), 1), round(float(rng.random() * 5), 1)))
    pdf = pd.DataFrame(rows, columns=["location", "year", "date", "stage", "obs", "sim"])
    got = {r.location: r for r in shape.season_shape(spark.createDataFrame(pdf), ["location", "year"], "date", "stage", "obs", "sim").collect()}
    pdf["date"] = pd.to_datetime(pdf.date)
    for loc, g in pdf.groupby("location"):
        if len(g) < 5:
            assert loc not in got
            continue
        for name, value in reference_shape(g).items():
            mine = got[loc][name]
            assert (mine is None) == (value is None), (loc, name)
            assert value is None or np.isclose(mine, value), (loc, name, mine, value)


@pytest.mark.parametrize("n, parts", [(12, 5), (3, 60), (40, 60), (1, 4), (200, 7)])
def test_centred_means_of_one_long_series(spark, n, parts):
    rng = random.Random(n)
    rows = [(i % 2 if i % 5 else None, i, rng.random() if rng.random() > 0.02 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    back, ahead = n // 2, n - n // 2 - 1
    pdf = df.toPandas()
    # Without a key the ranges of one series; with one, short series inside and across ranges.
    for by, series_ in (((), [pdf]), (("k",), [p for _, p in pdf.groupby("k", dropna=False)])):
        out = series.centred_mean(df, "v", ["t"], n, by, parts=parts)
        assert out.columns == ["k", "t", "v", "centred"]
        got = {r.t: r.centred for r in out.collect()}
        assert len(got) == len(rows)
        for part in series_:
            part = part.sort_values("t").reset_index(drop=True)
            for i, t in enumerate(part.t):
                own = part.v[max(0, i - back):i + ahead + 1].dropna()
                assert got[t] == (pytest.approx(own.mean()) if len(own) == n else None)
    staged = ordered.with_halo(df, ["t"], back, ahead, parts)
    assert staged.filter("_own").select("_part").distinct().count() > min(parts, 5) // 2 and staged.filter("_own").count() == len(rows)


def test_a_long_list_is_kept_in_chunks(spark):
    df = spark.range(1_000_000).select(F.lit("p").alias("name"), F.col("id").alias("idx"), (F.col("id") * 2).alias("value"))
    lists = relational.chunked_lists(df, [], "name", chunk=10_000)
    got = lists.select("chunk", F.size("values").alias("n"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last")).collect()
    assert sorted((r.chunk, r.n, r.first, r.last) for r in got) == [(k, 10_000, k * 20_000, k * 20_000 + 19_998) for k in range(100)]
    with pytest.raises(Exception, match="chunked_lists"):
        relational.unflatten_lists(df, [], "name").collect()


def test_layout_that_is_not_contiguous_is_seen(spark, monkeypatch):
    from obsim.catalog import load

    def digests():
        return {r.location: (r.contiguous, r.order_digest) for r in load().run("location_contiguous_layout", spark, "/root/testdata/sf0.001").collect()}

    right = digests()
    monkeypatch.setattr(sampling, "contiguous_layout", lambda df, key, order, parts=None: df.repartition(3, "k").sortWithinPartitions("k"))
    assert digests() != right


def test_objects_in_replies(spark):
    from obsim.functions import text

    big = "{" + ",".join(f'"x{i}":{{"y":"}}{{"}}' for i in range(20_000)) + "}"
    cases = {
        'so {"a":"}"} y }': '{"a":"}"}', '{"a":"\\\\"} }': '{"a":"\\\\"}', 'x {"a":"\\"}{"} {': '{"a":"\\"}{"}', '{"a":{"b":{}}}}}': '{"a":{"b":{}}}',
        "{'a'}": None, '{"a": "open}': None, '{"a":1': None, "": None, "}{": None, f"note {big} tail }}": big, 'f ```json\n{"a":2}\n``` {"z":1}': '{"a":2}',
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: r.j for r in df.select("i", text.json_in_text("c").alias("j")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_running_joins_short_summaries_only(spark):
    df = spark.createDataFrame(skewed(5000))
    out = ordered.running(df, ["k"], ["t", "id"], {"top": ("max", "v"), "n": ("count", "v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("keys", [1, 3, 40])
def test_running_where_keys_fill_several_partitions(spark, keys):
    rows = [(None if i % keys == 0 else i % keys, i, None if i % 7 == 0 else (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = {(r.k, r.t): (r.low, r.n, r.seen) for r in ordered.running(
        df, ["k"], ["t"], {"low": ("min", "v"), "n": ("count", "v"), "seen": ("last", "v")}).collect()}
    state: dict = {}
    for k, t, v in rows:
        low, n, seen = state.get(k, (None, 0, None))
        if v is not None:
            low, n, seen = v if low is None else min(low, v), n + 1, v
        state[k] = (low, n, seen)
        assert got[k, t] == (low, n, seen)


def test_rows_and_tied_sites_of_a_place_are_written_in_blocks(spark, tmp_path):
    """One place with 3,000 sites and 400 rows: each row with each site once, and the file does not hold every site again for every row."""
    left = spark.createDataFrame([*[(p, 1.2, 2.0) for p in range(400)], (400, None, 1.0), (400, 1.2, 2.0), (7, 1.2, 2.0)], "p long, px double, py double")
    right = spark.range(6000).select((F.col("id") * 7919).alias("s"), (F.col("id") % 2 * 5.0).alias("x"), F.lit(2.0).alias("y"))
    got = spatial.nearest(left, right, "px", "py", "x", "y", "s", ties="all").select("p", "nearest_id")
    got.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = left.filter("px is not null").select("p").join(right.filter("x = 0").select(F.col("s").alias("nearest_id")))
    want = want.union(spark.sql("select 400L, cast(null as bigint)"))
    assert back.count() == 402 * 3000 + 1 and back.exceptAll(want).count() == 0
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.4 * back.count()
