"""Nulls, constant ranges, tied knots, headers and digests: cases that tables without them do not show."""

import pytest
from pyspark.sql import functions as F

from obsim.functions import numeric, text
from obsim.operators import aggregates, quality, relational, series, spatial
from obsim.plans import views
from obsim.sources import consolidate, scan


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_null_gets_no_bound_bin_or_pixel(spark):
    nothing = F.lit(None).cast("double")
    got = one(
        spark, clip=numeric.clip(nothing, 10.0, 40.0), rel=numeric.value_bounds(nothing, clip_to=(0.0, 9.0)),
        ab=numeric.value_bounds(nothing, mode="absolute", low=0.0, high=9.0), eq=numeric.equal_bin(nothing, F.lit(0.0), F.lit(1.0), 4),
        hist=numeric.histogram_bin(nothing, F.lit(0.0), F.lit(1.0), 4), pixel=spatial.pixel_index(nothing, 0.0, 1.0, 5),
    )
    assert list(got) == [None] * 6


def test_constant_range_is_the_first_bin(spark):
    x = F.lit(3.0)
    got = one(spark, eq=numeric.equal_bin(x, x, x, 4), hist=numeric.histogram_bin(x, x, x, 4))
    assert list(got) == [1, 0]


def test_density_leaves_null_points_out(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 2.0)], "x double, y double")
    got = {(r.x, r.y): r.density for r in aggregates.density_2d(df, "x", "y", 4).collect()}
    assert got == {(1.0, 1.0): 1, (2.0, 2.0): 1}


@pytest.mark.parametrize("most", [64, 0])
def test_tied_knots_and_null_places_on_both_paths(spark, monkeypatch, most):
    monkeypatch.setattr(series, "CELL_KNOTS", most)
    knots = spark.createDataFrame([(0.0, 10.0), (2.0, 20.0), (2.0, 30.0), (None, 5.0), (4.0, None)], "x double, y double")
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 5.0), (3, None), (4, -1.0)], "k int, x double")
    got = {r.k: r.interpolated for r in series.interpolate(df, "x", knots, "x", "y").collect()}
    assert got == {0: 17.5, 1: 25.0, 2: 25.0, 3: None, 4: 10.0}
    keyed = df.withColumn("g", F.lit("a"))
    within = series.interpolate_within(keyed, "x", knots.withColumn("g", F.lit("a")), ["g"], "x", "y").collect()
    assert {r.k: r.interpolated for r in within} == got


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "1_yearly.csv").write_text("Year;Location;Crop;Yield\n2001;7;maize;5.5\n")
    (tmp_path / "2_yearly.csv").write_text("")
    row, = scan.scan_results(spark, str(tmp_path), "Location bigint, Yield double").collect()
    assert (row.Location, row.Yield) == (7, 5.5)
    with pytest.raises(ValueError, match="no column Area"):
        scan.scan_results(spark, str(tmp_path), "Area double")
    (tmp_path / "3_yearly.csv").write_text("Location;Year;Crop;Yield\n8;2002;maize;6.5\n")
    with pytest.raises(Exception):  # Spark's own check of each header
        scan.scan_results(spark, str(tmp_path), "Location bigint, Yield double").collect()
    with pytest.raises(ValueError, match="header mismatch"):
        consolidate.assert_same_header(spark, str(tmp_path), "Year")


def test_overwrite_replaces_only_the_given_experiments(spark, tmp_path):
    out = str(tmp_path / "table")
    a = spark.createDataFrame([(1, 2000, 5.0, "a"), (2, 2000, 6.0, "b")], "Location int, Year int, Yield double, exp string")
    consolidate.consolidate(a, out, ["exp"], ["Location", "Year"])
    consolidate.consolidate(a.filter("exp = 'a'").withColumn("Yield", F.lit(9.0)), out, ["exp"], ["Location", "Year"], mode="overwrite")
    assert {(r.exp, r.Yield) for r in spark.read.parquet(out).collect()} == {("a", 9.0), ("b", 6.0)}


def test_equal_rows_do_not_cancel_in_a_digest(spark):
    schema = "g int, k int, v double"
    twice = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0)], schema)
    other = spark.createDataFrame([(1, 5, 3.0), (1, 5, 3.0)], schema)
    digests = [quality.row_digests(df, ["g"], ["k"], "v").first() for df in (twice, other, twice.repartition(2))]
    assert digests[0].digest != digests[1].digest and digests[0] == digests[2]


def test_wide_cells_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 5.0), (1, "b", 1.0)], "i int, c string, v double")
    for rows in (df, df.orderBy(F.desc("v")), df.orderBy("v")):
        assert tuple(relational.pivot_wide(rows, ["i"], "c", "v", ["a", "b"]).first()) == (1, 5.0, 1.0)


@pytest.mark.parametrize("reply,found", [
    ('text {"a": {"b": "}"}, "c": 1} more }', '{"a": {"b": "}"}, "c": 1}'), ('{"a": 1} {"a": 2}', '{"a": 1}'),
    ('first {x} then ```json\n{"k": 2}\n```', '{"k": 2}'), (None, None), ("} {", None),
])
def test_shortest_object_that_parses(spark, reply, found):
    assert one(spark, j=text.json_in_text(F.lit(reply).cast("string"))).j == found


def test_no_phenology_pair_is_an_error(spark):
    sim = spark.createDataFrame(
        [(1, 2001, "01.06.2001", 150, 200)], "PointID int, harvest_year int, anthesis_date string, flowering_doy_sim int, maturity_doy_sim int"
    )
    obs = spark.createDataFrame([(2, 2001, 151, 201)], "PointID int, harvest_year int, flowering_doy int, maturity_doy int")
    with pytest.raises(ValueError, match="no phenology pairs"):
        views.phenology_score(sim, obs)
