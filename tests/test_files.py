"""Sources, sinks and incremental consolidation on small files."""

import gzip
import time

import pytest

from obsim import session
from obsim.sources import catalog, consolidate, scan
from obsim.streaming import incremental

SCHEMA = "Location bigint, Year int, Yield double"


def write(folder, name, lines, newline=True):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + ("\n" if newline else ""))


def test_scratch_folder_comes_from_the_session(spark, monkeypatch):
    named = {"spark.checkpoint.dir": "/shared/stage/"}

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: named.get(key, default))

        sparkContext = spark.sparkContext

    assert session.scratch_path(Session, "x").startswith("/shared/stage/x-")
    named.clear()
    monkeypatch.setattr(session, "_LOCAL_SCRATCH", {})
    local = session.scratch_root(Session)
    assert local.startswith("/tmp/spark-") and session.scratch_root(Session) == local

    class Remote:
        master, applicationId = "k8s://cluster", "a"

    Session.sparkContext = Remote
    with pytest.raises(ValueError, match="shared folder"):
        session.scratch_root(Session)


def test_scan_handles_missing_newline_and_empty_files(spark, tmp_path):
    write(tmp_path, "1_yearly.csv", ["Location;Year;Yield", "1;2000;5.5"], newline=False)
    write(tmp_path, "2_yearly.csv", ["Location;Year;Yield", "2;2000;6.5", "2;2001;7.0"])
    write(tmp_path, "3_yearly.csv", ["Location;Year;Yield"])
    (tmp_path / "4_yearly.csv").write_text("")
    assert scan.scan_results(spark, str(tmp_path), SCHEMA).count() == 3
    assert consolidate.assert_same_header(spark, str(tmp_path), "Location") == ["Location", "Year", "Yield"]


def test_header_mismatch_and_no_files_are_errors(spark, tmp_path):
    write(tmp_path / "a", "1_yearly.csv", ["Location;Year;Yield", "1;2000;5.5"])
    write(tmp_path / "a", "2_yearly.csv", ["Location;Yield;Year", "2;6.5;2000"])
    with pytest.raises(ValueError, match="header mismatch"):
        consolidate.assert_same_header(spark, str(tmp_path / "a"), "Location")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="result files"):
        scan.scan_results(spark, str(tmp_path / "none"), SCHEMA)


def test_even_sample_of_files(spark, tmp_path):
    for i in range(10):
        write(tmp_path, f"{i}_yearly.csv", ["Location;Year;Yield", f"{i};2000;1.0"])
    got = sorted(r.Location for r in scan.scan_results(spark, str(tmp_path), SCHEMA, sample=3).collect())
    assert got == [0, 4, 9]


def test_run_catalog_keeps_the_own_namespace(spark, tmp_path):
    for crop, exp, space in (("maize", "MIROC6_ssp126__S1", "MIROC6_ssp126__S1"), ("maize", "MIROC6_ssp126__S1", "SMOKE_MIROC6_ssp126__S1"), ("potato", "DWD__DL", "DWD__DL")):
        write(tmp_path / crop / "runs" / exp / "out" / space / "yearly", "7_yearly.csv", ["Location;Year;Yield"])
        write(tmp_path / crop / "runs" / exp / "out" / space / "yearly", "notes.csv", ["x"])
    files = catalog.yearly_files(catalog.file_catalog(spark, str(tmp_path), "*.csv"))
    got = {(r.crop, r.climate, r.soil, r.location) for r in catalog.runs(files).collect()}
    assert got == {("maize", "MIROC6_ssp126", "S1", 7), ("potato", "DWD", "DL", 7)}
    assert catalog.runs(files, soils=["DL"]).count() == 1


def test_check_log_positions_come_from_each_header(spark, tmp_path):
    write(tmp_path, "a.csv", [
        "Session", "CheckMethod\tD\tC\tT\tVariableName\tAdditionalInformation", "checkResult\td\tc\tt\tLAI\tvalue -3.5e2 at 12",
        "checkLimits\td\tc\tt\tLAI\t9\t0\t8", "too\tshort",
    ])
    write(tmp_path, "b.csv", ["Session", "VariableName\tCheckMethod\tAdditionalInformation", "N\tcheckResult\tall 7 fine"])
    got = {(r.method, r.variable, r.kind) for r in scan.scan_check_log(spark, str(tmp_path)).collect()}
    assert got == {
        ("checkResult", "LAI", "value # at #"), ("checkLimits", "LAI", "value outside limits [0, 8]"), ("checkResult", "N", "all # fine"),
    }


def test_parameter_xml_scalars_lists_and_absent_ids(spark, tmp_path):
    write(tmp_path, "crop.xml", [
        "<crops><crop id='w'>", "<parameter id='A'>1.5</parameter>",
        "<parameter id='T'><value>0.1</value><value>0.2</value></parameter>", "</crop></crops>",
    ])
    got = scan.scan_params_xml(spark, str(tmp_path / "crop.xml"), set_id="_id")
    assert {(r.set_id, r.param, r.idx, r.value) for r in got.collect()} == {("w", "A", 0, 1.5), ("w", "T", 0, 0.1), ("w", "T", 1, 0.2)}
    wanted = spark.createDataFrame([("w", "A"), ("w", "Z")], "set_id string, param string")
    assert {(r.param, r.value) for r in scan.requested_params(wanted, got).collect()} == {("A", 1.5), ("Z", None)}


def test_comments_gzip_and_grid_json(spark, tmp_path):
    write(tmp_path, "co2.csv", ["# note", "year,co2_ppm", "1990,354.0"])
    assert scan.scan_commented(spark, str(tmp_path / "co2.csv"), "year int, co2_ppm double").first().co2_ppm == 354.0
    (tmp_path / "w").mkdir()
    with gzip.open(tmp_path / "w" / "daily_C3R4.csv.gz", "wt") as fh:
        fh.write("Date\tRain\n2000-01-01\t1.5\n")
    w = scan.scan_weather(spark, [("obs", str(tmp_path / "w"), "\t")], "Date date, Rain double").first()
    assert (w.vColumn, w.vRow, w.Rain, w.source) == (3, 4, 1.5, "obs")
    (tmp_path / "grid.json").write_text("[[[50.1, 8.2],\n [3, 4]], [[50.2, 8.3], [5, 6]]]")
    got = scan.scan_grid_json(spark, str(tmp_path / "grid.json"), whole_files=True).collect()
    assert [(r.lat, r.lon, r.row, r.col) for r in got] == [(50.1, 8.2, 3, 4), (50.2, 8.3, 5, 6)]


def test_ledger_skips_blank_lines(spark, tmp_path):
    write(tmp_path, "l.jsonl", ['{"iteration": 0, "status": "completed", "objective": 1.0, "parameters_changed": {"A": "2"}}', "", '{"iteration": 1, "status": "failed"}'])
    rows = scan.scan_ledger(spark, str(tmp_path / "l.jsonl")).filter("iteration IS NOT NULL").orderBy("iteration").collect()
    assert [(r.iteration, r.objective) for r in rows] == [(0, 1.0), (1, None)]


def test_manifest_rules(spark):
    old = spark.createDataFrame([("maize", "a", 1), ("maize", "b", 2)], "crop string, exp_id string, n int")
    new = spark.createDataFrame([("maize", "b", 9, "written"), ("maize", "c", 3, "error"), ("maize", "d", 4, "skipped")], "crop string, exp_id string, n int, status string")
    got = [(r.exp_id, r.n) for r in consolidate.upsert_manifest(old, new, ["crop", "exp_id"]).collect()]
    assert got == [("a", 1), ("b", 9), ("d", 4)]


def test_incremental_consolidation_reads_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for i in range(3):
        write(tmp_path / "src", f"{i}_yearly.csv", ["Location;Year;Yield", f"{i};2000;1.0"])
        incremental.consolidate_stream(spark, src, out, SCHEMA, check, ["Location"]).awaitTermination()
    got = incremental.read_consolidated(spark, out, SCHEMA)
    assert sorted((r.Location, r.batch_id) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]
    incremental.consolidate_stream(spark, src, out, SCHEMA, check).awaitTermination()
    assert incremental.read_consolidated(spark, out, SCHEMA).count() == 3


def test_incomplete_experiments_are_reported_once_their_time_is_over(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    expected = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "experiment string, expected long")

    def call(wait_ms):
        incremental.watch_arrivals(spark, src, "/exp_([^/]*)/", expected, out, check, wait_ms).awaitTermination()
        return {r.experiment: (r.seen, r.expected, r.status) for r in incremental.arrival_status(spark, out).collect()}

    for exp, place in (("a", 1), ("a", 2), ("b", 1), ("unknown", 1)):
        write(tmp_path / "src" / f"exp_{exp}", f"{place}.csv", ["x", "1"])
    assert call(10) == {"a": (2, 2, "complete"), "b": (1, 3, "waiting")}
    time.sleep(0.1)
    # A new file of any experiment lets the timers report.
    write(tmp_path / "src" / "exp_c", "1.csv", ["x", "1"])
    got = call(10)
    assert got["b"] == (1, 3, "incomplete") and got["c"] == (1, 1, "complete")
    for place in (2, 3):
        write(tmp_path / "src" / "exp_b", f"{place}.csv", ["x", "1"])
    assert call(10) == {"a": (2, 2, "complete"), "b": (3, 3, "complete"), "c": (1, 1, "complete")}


def test_log_positions_come_from_the_first_block(spark, tmp_path, monkeypatch):
    head = "CheckMethod\tX\tVariableName\tAdditionalInformation"
    write(tmp_path, "a.log", ["Session", head, "checkResult\t-\tv1\tday 12", "checkResult\t-\tv2\tday 13", "short"])
    write(tmp_path, "b.log", ["Session", "no header", "checkResult\t1\t2\t3\tv9\tday 4", "checkLimits\t1\t2\t3\tv8\t7.5\t0\t5"])
    rows = []
    for most in (scan.MOST_HEADERS, 0):
        monkeypatch.setattr(scan, "MOST_HEADERS", most)
        got = scan.scan_check_log(spark, str(tmp_path))
        rows.append(sorted((r.method, r.variable, r.kind) for r in got.collect()))
    assert rows[0] == rows[1] == [
        ("checkLimits", "v8", "value outside limits [0, 5]"), ("checkResult", "v1", "day #"), ("checkResult", "v2", "day #"), ("checkResult", "v9", "day #"),
    ]
