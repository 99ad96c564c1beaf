"""Synthetic cases whose answer is known in advance."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from obsim.functions import arrays, dates, geo, numeric, text
from obsim.operators import ledger, metrics, quality, relational, scenario, series, spatial
from obsim.plans import diagnose, views

EDGES = [0.0, 0.25, 0.5, 1.0, 1.25, 1.5, 1.75, 2.0]


def canopy(spark, factor=1.0, shift=0.0):
    rows = []
    for loc in range(6):
        day, i = dt.date(2018, 3, 1), 0
        days = []
        while day <= dt.date(2018, 8, 1):
            days.append(day)
            day += dt.timedelta(days=8)
        for i, d in enumerate(days):
            s = 0.1 + 1.9 * i / (len(days) - 1)
            obs = 4 * math.exp(-((s - 1) ** 2) / 0.35)
            sim = factor * 4 * math.exp(-((s - 1 - shift) ** 2) / 0.35)
            rows.append((loc, 2018, d, s, obs, sim))
    return spark.createDataFrame(rows, "location int, year int, date date, dvs double, LAI double, LAI_sim double")


def blocks(df, *names):
    return {k: {r[0]: r for r in v.collect()} for k, v in diagnose.diagnose_canopy(df, EDGES, blocks=names).items()}


def test_level_bias_shows_in_every_bin(spark):
    got = blocks(canopy(spark, factor=1.3), "overall", "shape", "by_stage")
    assert list(got["overall"].values())[0].bias > 0.2
    assert got["shape"]["peak"].median_diff > 0.5
    assert got["shape"]["peak_timing"].median_diff == 0
    assert all(r.bias > 0 for r in got["by_stage"].values())


def test_phase_shift_flips_the_bin_sign(spark):
    got = blocks(canopy(spark, shift=0.3), "shape", "by_stage")
    assert got["shape"]["peak_timing"].median_diff > 0
    signs = {np.sign(r.bias) for r in got["by_stage"].values()}
    assert signs == {-1.0, 1.0}


def yield_frame(spark, obs, biomass, sim, n=40):
    rows = [(f"D{i % 8}", "S1" if i % 8 < 4 else "S2", 2000 + i // 8, obs, biomass, sim) for i in range(n)]
    return spark.createDataFrame(rows, "NUTS_ID string, STATE_NAME string, year int, yield double, biomass double, yield_sim double")


REFERENCE = {"harvest_index": (0.4, 0.55), "biomass": (12.0, 18.0)}


def test_attribution_names_index_or_biomass(spark):
    index = diagnose.yield_attribution(yield_frame(spark, 6.0, 15.0, 3.0), REFERENCE).first()
    assert index.verdict.startswith("partitioning")
    mass = diagnose.yield_attribution(yield_frame(spark, 6.0, 6.0, 2.7), REFERENCE).first()
    assert mass.verdict.startswith("biomass")
    none = diagnose.yield_attribution(yield_frame(spark, 6.0, 6.0, 2.7)).first()
    assert none.hi_ok is None and none.verdict == "no reference ranges given"


def test_spatial_error_exceeds_temporal(spark):
    rows = [(d, s, y, 6.0 + (1.5 if s == "S2" else 0.0), 6.75) for y in range(2000, 2010) for d, s in (("A", "S1"), ("B", "S2"))]
    df = spark.createDataFrame(rows, "NUTS_ID string, STATE_NAME string, year int, yield double, yield_sim double")
    got = views.yield_loss(df).first()
    assert got.rmse_STATE_NAME == pytest.approx(0.75)
    assert got.rmse_year == pytest.approx(0.0, abs=1e-12)
    assert got.loss == pytest.approx(0.375)


def test_harvest_index_medians_leave_the_loss_alone(spark):
    rng = np.random.default_rng(1)
    rows = [(f"D{i % 20}", f"S{i % 4}", 2000 + i % 10, float(b) * 0.45, float(b), float(b) * 0.37) for i, b in enumerate(rng.normal(16, 1.5, 200))]
    df = spark.createDataFrame(rows, "NUTS_ID string, STATE_NAME string, year int, yield double, biomass double, yield_sim double")
    hi = views.harvest_index_medians(df).first()
    assert hi.hi_sim == pytest.approx(0.37) and hi.hi_required == pytest.approx(0.45)
    assert views.harvest_index_medians(df.drop("biomass")).count() == 0
    assert views.yield_loss(df).first().loss == pytest.approx(views.yield_loss(df.drop("biomass")).first().loss)


@pytest.mark.parametrize("plain,moved,verdict", [
    (-0.8, -0.05, "other fits better"), (-0.02, 1.2, "other fits worse"), (0.1, -0.1, "indistinguishable"),
])
def test_translocation_comparison(spark, plain, moved, verdict):
    from obsim.operators.aggregates import compare_series

    rows = [(5.0 + i / 10, 5.0 + i / 10 + plain, 5.0 + i / 10 + moved) for i in range(10)]
    df = spark.createDataFrame(rows, "o double, p double, m double")
    assert compare_series(df, "o", "p", "m").first().verdict == verdict
    assert compare_series(df.limit(4), "o", "p", "m").count() == 0


@pytest.mark.parametrize("dflower,dmature,wants,lacks", [
    (6, 6, "TSUM1", "TSUM2"), (0, -7, "TSUM2", "TSUM1"), (0, 0, "no change", "TSUM"),
])
def test_flowering_versus_duration(spark, dflower, dmature, wants, lacks):
    rows = [(i, 2000 + i % 8, 150 + (i * 7) % 11, 210 + (i * 5) % 9) for i in range(80)]
    df = spark.createDataFrame(rows, "PointID int, harvest_year int, flowering_doy int, maturity_doy int").select(
        "*", (F.col("flowering_doy") + dflower).alias("flowering_doy_sim"), (F.col("maturity_doy") + dmature).alias("maturity_doy_sim"),
    ).withColumn("duration_obs", F.col("maturity_doy") - F.col("flowering_doy")).withColumn(
        "duration_sim", F.col("maturity_doy_sim") - F.col("flowering_doy_sim"))
    verdict = diagnose.diagnose_phenology(df, blocks=["structure"])["structure"].first().verdict
    assert wants in verdict and lacks not in verdict.replace(wants, "")


def test_latitude_block_needs_points(spark):
    df = spark.createDataFrame(
        [(i, 2000, 150, 150 + i // 4, 200, 200, 50, 50) for i in range(40)],
        "PointID int, harvest_year int, flowering_doy int, flowering_doy_sim int, maturity_doy int, maturity_doy_sim int, duration_obs int, duration_sim int",
    )
    assert "by_latitude" not in diagnose.diagnose_phenology(df, blocks=["by_year"])
    pts = spark.createDataFrame([(i, 47.0 + i * 0.1) for i in range(40)], "PointID int, Latitude double")
    got = diagnose.diagnose_phenology(df, pts, blocks=["structure", "by_latitude"])
    assert got["structure"].first().latitude_slope == pytest.approx(2.5, rel=0.05)
    assert [r.n for r in got["by_latitude"].orderBy("band").collect()] == [10, 10, 10, 10]


# ------------------------------------------------------------------- objective


def test_combine(spark):
    comp = spark.createDataFrame([("lai", 0.5, 0.15), ("yield", 0.5, 0.5)], "component string, weight double, scale double")

    def objective(*rows):
        return metrics.combine(spark.createDataFrame(list(rows), "component string, loss double"), comp).first().objective

    assert objective(("lai", 0.15), ("yield", 0.5)) == pytest.approx(1.0)
    assert objective(("lai", 0.075), ("yield", 0.5)) == pytest.approx(0.75)
    with pytest.raises(PySparkException, match="no loss"):
        objective(("lai", 0.15))


def test_agreement_edge_cases(spark):
    def run(rows):
        return metrics.agreement(spark.createDataFrame(rows, "o double, s double"), "o", "s").first()

    one = run([(1.0, 2.0), (float("nan"), 1.0), (None, 1.0), (float("inf"), 3.0)])
    assert one.n == 1 and one.rmse is None
    flat = run([(2.0, 1.0), (2.0, 3.0)])
    assert flat.r2 is None and flat.ef is None and flat.rmse == pytest.approx(1.0)
    zero_mean = run([(-1.0, 0.0), (1.0, 0.0)])
    assert zero_mean.nrmse_pct is None


# ---------------------------------------------------------------------- ledger

LEDGER = "iteration int, status string, objective double"


def test_ledger_progress(spark):
    df = spark.createDataFrame([(0, "completed", 1.0), (1, "completed", 0.8), (2, "completed", 0.9), (3, "completed", 0.85)], LEDGER)
    s = ledger.stop_status(df, patience=3, max_iterations=10, target=0.1).first()
    assert (s.best_iteration, s.since_improvement, s.stop) == (1, 2, False)
    assert ledger.stop_status(df, patience=2).first().stop
    assert ledger.stop_status(df, max_iterations=4).first().reason == "iteration limit reached"
    flags = {r.iteration: (r.improved, r.is_best, r.accepted) for r in ledger.running_best(df, min_improvement=0.25).collect()}
    assert flags == {0: (True,) * 3, 1: (False, True, True), 2: (False,) * 3, 3: (False,) * 3}
    assert all(r.accepted for r in ledger.running_best(df, acceptance="latest").collect())


def test_failed_records_never_count(spark):
    df = spark.createDataFrame([(0, "completed", 0.7), (1, "failed", None)], LEDGER)
    assert ledger.next_id(df).first().next_id == 2
    assert ledger.best_record(df).first().iteration == 0
    assert ledger.stop_status(df).first().n_completed == 1
    assert ledger.next_id(df.limit(0)).first().next_id == 0
    for none in (df.limit(0), df.filter("status = 'failed'")):
        s = ledger.stop_status(none, patience=1, target=1.0, max_iterations=1).first()
        assert (s.n_completed, s.stop, s.since_improvement, s.reason) == (0, False, 0, "no completed iterations yet")


# ----------------------------------------------------------------------- rules


def table(spark, values, group="g"):
    return spark.createDataFrame([(group, i, float(v), i * 0.5) for i, v in enumerate(values)], "g string, i int, v double, x double")


def test_rules_on_short_tables(spark):
    def n(df):
        return df.count()

    assert n(quality.check_smooth(table(spark, [1, 2, 4]), ["g"], "i", "v", 2.0)) == 0
    assert n(quality.check_smooth(table(spark, [1, 2.1, 0, 5]), ["g"], "i", "v", 2.0)) == 1
    assert n(quality.check_monotone(table(spark, [1, 2, 1.5]), ["g"], "i", "v")) == 1
    assert n(quality.check_monotone(table(spark, [1, 2, 1.5]), ["g"], "i", "v", tolerance=0.5)) == 0
    assert n(quality.check_monotone(table(spark, [1, 5, 4, 3]), ["g"], "i", "v", "non_increasing", position="x", from_x=0.5)) == 0
    assert n(quality.check_endpoint(table(spark, [1, 3, 2]), ["g"], "i", "v")) == 0
    assert n(quality.check_endpoint(table(spark, [1, 3, 4]), ["g"], "i", "v")) == 1
    assert n(quality.check_endpoint(table(spark, [9]), ["g"], "i", "v")) == 0
    assert n(quality.check_endpoint(table(spark, [1, 3, 2]), ["g"], "i", "v", "last_le_first")) == 1
    assert n(quality.check_step(table(spark, [1, 0]), table(spark, [1.5, 9]), ["g", "i"], "v", 0.5)) == 0
    assert n(quality.check_step(table(spark, [1]), table(spark, [1.6]), ["g", "i"], "v", 0.5)) == 1


def closure_rows(spark, rows):
    return spark.createDataFrame(rows, "g int, m string, x double, v double")


def test_closure_reports_only_new_breakage(spark, monkeypatch):
    before = closure_rows(spark, [(1, "a", 0.0, 0.4), (1, "a", 2.0, 0.6), (1, "b", 0.0, 0.6), (1, "b", 1.0, 0.5), (1, "b", 2.0, 0.4)])
    moved = closure_rows(spark, [(1, "a", 0.0, 0.4), (1, "a", 2.0, 0.8), (1, "b", 0.0, 0.6), (1, "b", 1.0, 0.5), (1, "b", 2.0, 0.4)])
    broken = closure_rows(spark, [(1, "a", 0.0, 0.4), (1, "a", 2.0, 0.9), (1, "b", 0.0, 0.6), (1, "b", 1.0, 0.5), (1, "b", 2.0, 0.4)])
    for limit in (1, 64):
        monkeypatch.setattr(series, "CELL_KNOTS", limit)
        args = (["g"], "m", "x", "v")
        assert quality.check_closure(before, before, *args).count() == 0
        # The table a is interpolated at node 1, which b alone defines.
        got = {(r.node, round(r.total, 6)) for r in quality.check_closure(before, moved, *args).collect()}
        assert got == {(1.0, 1.1), (2.0, 1.2)}
        # What was broken before is tolerated.
        assert quality.check_closure(broken, broken, *args).count() == 0


def test_closure_of_even_grids_is_one_sum_a_node(spark, monkeypatch):
    before = closure_rows(spark, [(g, m, float(n), 0.5) for g in (1, 2) for m in "ab" for n in range(3)])
    moved = closure_rows(spark, [(g, m, float(n), 0.7 if (g, m, n) == (2, "a", 1) else 0.5) for g in (1, 2) for m in "ab" for n in range(3)])

    def refused(*_):
        raise AssertionError("even grids need no staged knots")

    monkeypatch.setattr(quality, "stage", refused)
    got = [(r.g, r.node, round(r.total, 6)) for r in quality.check_closure(before, moved, ["g"], "m", "x", "v").collect()]
    assert got == [(2, 1.0, 1.2)]


def test_closure_of_members_without_a_common_knot(spark):
    before = closure_rows(spark, [(1, "a", 0.0, 0.4), (1, "a", 2.0, 0.4), (1, "b", 1.0, 0.6), (1, "b", 3.0, 0.6)])
    moved = closure_rows(spark, [(1, "a", 0.0, 0.4), (1, "a", 2.0, 0.4), (1, "b", 1.0, 0.8), (1, "b", 3.0, 0.8)])
    args = (["g"], "m", "x", "v")
    assert quality.check_closure(before, before, *args).count() == 0
    assert {round(r.total, 6) for r in quality.check_closure(before, moved, *args).collect()} == {1.2}


def test_ordering_skips_missing_keys(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 5.0)], "g int, n string, v double")
    assert [r.g for r in quality.check_ordering(df, ["g"], "n", "v", "a", "<", "b").collect()] == [1]
    assert quality.check_ordering(df, ["g"], "n", "v", "a", ">=", "b").count() == 0


def test_protected_values(spark):
    was = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 2.0), ("q", 0, 3.0)], "p string, i int, v double")
    now = spark.createDataFrame([("p", 0, 1.0 + 1e-12), ("p", 1, 2.5), ("r", 0, 4.0)], "p string, i int, v double")
    got = {(r.p, r.i) for r in quality.check_protected(was, now, ["p", "i"], "v").collect()}
    assert got == {("p", 1), ("q", 0), ("r", 0)}


# ------------------------------------------------------------------- functions


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("value,seconds", [
    ("1-02:03:04", 93784), ("1-02:03", 93780), ("1-06", 108000), ("03:00:00", 10800), ("05:30", 330), ("90", 5400),
])
def test_durations(spark, value, seconds):
    assert one(spark, s=dates.duration_seconds(F.lit(value))).s == seconds


def test_bad_grid_id_is_an_error(spark):
    assert one(spark, c=text.grid_column(F.lit(" C325R23 "))).c == 325
    with pytest.raises(PySparkException, match="bad grid id"):
        one(spark, c=text.grid_column(F.lit("C3R")))


@pytest.mark.parametrize("reply,found", [
    ('{"a": 1}', 1), ('x ```json\n{"a": 2}\n``` y', 2), ('say {"a": 3, "b": "}"} and {more', 3), ("```\n[1]\n``` {\"a\": 4}", 4),
    ("nothing", None), ("{ broken", None), ("[1, 2]", None), ('{"s": "\\"{", "a": 5} tail', 5),
])
def test_json_in_replies(spark, reply, found):
    got = one(spark, a=F.get_json_object(text.json_in_text(F.lit(reply)), "$.a")).a
    assert got == (None if found is None else str(found))


def test_array_edits(spark):
    arr = F.array(*[F.lit(float(i)) for i in range(4)])
    got = one(spark, a=arrays.edit_at(arr, F.create_map(F.lit("2"), F.lit(9.0)))).a
    assert got == [0.0, 1.0, 9.0, 3.0]
    with pytest.raises(PySparkException, match="out of range"):
        one(spark, a=arrays.edit_at(arr, F.create_map(F.lit("4"), F.lit(9.0))))
    with pytest.raises(PySparkException, match="length"):
        one(spark, a=arrays.replace_all(arr, F.array(F.lit(1.0))))


def test_metric_grid_known_points(spark):
    # The central meridian maps to the false easting; one degree of latitude is about 111 km.
    a = one(spark, u=geo.utm_xy(F.lit(9.0), F.lit(50.0))).u
    assert a.x == pytest.approx(500000.0, abs=1e-6)
    assert a.y == pytest.approx(5538630.70, abs=0.05)
    east = one(spark, u=geo.utm_xy(F.lit(10.0), F.lit(50.0))).u
    west = one(spark, u=geo.utm_xy(F.lit(8.0), F.lit(50.0))).u
    assert east.x - 500000 == pytest.approx(500000 - west.x, abs=1e-6)
    assert east.x == pytest.approx(571666.4, abs=1.0)


def test_bins_match_pandas(spark):
    import pandas as pd

    xs = [0.0, 0.25, 0.26, 1.0, 1.999, 2.0, 2.1, -0.1]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.edge_bin("x", EDGES).alias("b"))
    want = pd.cut(xs, EDGES, include_lowest=True).codes
    assert [(-1 if r.b is None else r.b) for r in df.collect()] == list(want)
    vals = [1.0, 2.0, 3.5, 4.0, 9.0, 5.0]
    lo, hi = F.lit(min(vals)), F.lit(max(vals))
    got = spark.createDataFrame([(x,) for x in vals], "x double").select(numeric.equal_bin("x", lo, hi, 4).alias("b")).collect()
    assert [r.b - 1 for r in got] == list(pd.cut(vals, 4).codes)


def test_null_dates_fail_the_sequence_and_never_flag(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1), None), (2, dt.date(2000, 1, 1), dt.date(2000, 2, 1))], "i int, a date, b date")
    assert [r.i for r in relational.valid_sequence(df, ["a", "b"]).collect()] == [2]
    flagged = relational.flag_prior_year(df, "b", F.lit(2001)).collect()
    assert {r.i: r.abnormal for r in flagged} == {1: False, 2: True}


def test_asserts_name_the_problem(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="absent"):
        relational.assert_covered(df, df.filter("k = 1"), ["k"])
    relational.assert_covered(df, df, ["k"])
    with pytest.raises(ValueError, match="matched"):
        relational.assert_not_empty(df.filter("k > 5"))
    with pytest.raises(ValueError, match="not unique"):
        relational.assert_single_value(df, "k", "span")
    with pytest.raises(ValueError, match="unknown soil"):
        scenario.pick("S1,XX", scenario.SOILS, "soil")
    assert scenario.pick("all", scenario.SOILS, "soil") == scenario.SOILS


def test_design_sizes(spark):
    climates = scenario.climate_registry(spark)
    assert climates.count() == 17
    assert scenario.scenario_matrix(spark, scenario.CROPS, climates, scenario.SOILS).count() == 425


def test_spliced_series_is_gap_free(spark):
    rows = [(y, m, 320 + (y - 1958) * 1.2 + 3 * math.sin(m)) for y in range(1958, 1980) for m in range(1, 13) if (y, m) >= (1958, 3)]
    obs = spark.createDataFrame(rows, "year int, month int, average double")
    trend = spark.createDataFrame([(y, 312 + (y - 1951) * 1.1) for y in range(1945, 1985)], "year int, level double")
    out = series.splice(obs, trend, 1951, (1958, 1963), (1959, 1978))
    check = series.check_series(out).first()
    assert (check.n_missing, check.n_duplicated, check.first_year) == (0, 0, 1951)
    assert out.filter("reconstructed").count() == 7 * 12 + 2
    kept = {(r.year, r.month): r.average for r in out.filter("NOT reconstructed").collect()}
    assert kept == {(y, m): v for y, m, v in rows}


def test_units_are_told_from_pixels_that_hold_points(spark):
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.2, 0.1), (3, None, 0.0)], "location int, x double, y double")
    pixels = spark.createDataFrame([(0, 0, 1, 4.0), (0, 0, 2, 5.0), (1, 0, 1, 40.0)], "ix int, iy int, date int, value double")
    used = spatial.pixels_with_points(points, pixels, "x", "y", (0.0, 0.0), (1.0, 1.0), (2, 2))
    assert sorted((r.ix, r.iy, r.date, r.value) for r in used.collect()) == [(0, 0, 1, 4.0), (0, 0, 2, 5.0)]


def test_pixel_join_is_dealt_out_by_pixel(spark):
    points = spark.sql("select * from values (1, 0.1D, 0.1D) t(location, x, y)")
    pixels = spark.sql("select * from values (0, 0, 1, 4D), (0, 0, 2, 5D) t(ix, iy, date, value)")
    out = spatial.pixel_values(points, pixels, "x", "y", (0.0, 0.0), (1.0, 1.0), (2, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.location, r.date, r.value) for r in out.collect()) == [(1, 1, 4.0), (1, 2, 5.0)]


def test_tied_sites_are_dealt_out_by_position(spark):
    left = spark.sql("select * from values (1, 0.5D, 0D), (2, null, 0D) t(k, x, y)")
    right = spark.sql("select * from values (7, 0D, 0D), (8, 1D, 0D), (9, 1D, 0D), (10, 5D, 5D) t(site, sx, sy)")
    out = spatial.nearest(left, right, "x", "y", "sx", "sy", "site", ties="all")
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0]
    assert sorted((r.k, r.nearest_id or 0) for r in out.collect()) == [(1, 7), (1, 8), (1, 9), (2, 0)]
