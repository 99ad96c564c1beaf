"""The versioned store: what is rewritten, what readers see, and races between runs."""

import pytest

from obsim.sources import catalog, consolidate, manifest

SCHEMA = "Location bigint, Year int, Yield double"
KEYS = ["crop", "exp_id"]


def write(root, crop, exp, location, lines):
    folder = root / crop / "runs" / exp / "out" / exp / "yearly"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{location}_yearly.csv").write_text("\n".join(lines))


def run(spark, root, store, **options):
    files = catalog.runs(catalog.yearly_files(catalog.file_catalog(spark, str(root), "*.csv")))
    out = consolidate.consolidate_release(spark, files, str(store), SCHEMA, ["Location", "Year"], **options)
    return {(r.crop, r.exp_id): r for r in out.collect()}


def seen(spark, store, version=None):
    return sorted(tuple(r) for r in manifest.read_data(spark, str(store), KEYS, version).select("crop", "exp_id", "Location", "Year", "Yield").collect())


@pytest.fixture
def tree(tmp_path):
    head = "Location;Year;Yield"
    write(tmp_path, "maize", "A x+y__S1", 1, [head, "1;2000;5.5", "1;2001;6.5"])
    write(tmp_path, "maize", "A x+y__S1", 2, [head, "2;2000;7.5", ""])
    write(tmp_path, "wheat", "2020-01__01", 7, ["Year;Extra;Location;Yield", "2000;z;7;1.5"])
    write(tmp_path, "wheat", "zero__S1", 1, [""])
    write(tmp_path, "wheat", "bad__S1", 1, [head, "1;2000;5.5"])
    write(tmp_path, "wheat", "bad__S1", 2, ["Location;Yield;Year", "2;5.5;2000"])
    write(tmp_path, "wheat", "lacks__S1", 1, ["Location;Year", "1;2000"])
    return tmp_path


def test_statuses_and_counters(spark, tree):
    expected = spark.createDataFrame([("maize", "A x+y__S1"), ("rye", "none__S1"), ("wheat", "zero__S1")], "crop string, exp_id string")
    out = run(spark, tree, tree / "store", expected=expected)
    assert {k: r.status for k, r in out.items()} == {
        ("maize", "A x+y__S1"): "written", ("wheat", "2020-01__01"): "written", ("wheat", "zero__S1"): "empty",
        ("wheat", "bad__S1"): "error", ("wheat", "lacks__S1"): "error", ("rye", "none__S1"): "empty",
    }
    one = out["maize", "A x+y__S1"]
    assert (one.n_location_files, one.n_rows) == (2, 3) and one.out_bytes > 0
    assert one.src_bytes == sum(p.stat().st_size for p in (tree / "maize").rglob("*.csv"))
    assert out["wheat", "bad__S1"].message.startswith("header mismatch in ") and out["wheat", "lacks__S1"].message == "no column Yield"
    assert seen(spark, tree / "store") == [
        ("maize", "A x+y__S1", 1, 2000, 5.5), ("maize", "A x+y__S1", 1, 2001, 6.5), ("maize", "A x+y__S1", 2, 2000, 7.5),
        ("wheat", "2020-01__01", 7, 2000, 1.5),
    ]
    rows = manifest.read_manifest(spark, str(tree / "store")).collect()
    assert [(r.crop, r.exp_id, r.n_location_files, r.n_rows) for r in rows] == [("maize", "A x+y__S1", 2, 3), ("wheat", "2020-01__01", 1, 1)]


def test_only_stale_experiments_are_rewritten(spark, tree):
    store = tree / "store"
    run(spark, tree, store)
    first = {r.exp_id: r.release for r in manifest.read_manifest(spark, str(store)).collect()}
    before = seen(spark, store)
    # Nothing new: no version.
    again = run(spark, tree, store)
    assert {r.status for r in again.values()} == {"skipped", "error"} and manifest.latest(spark, str(store))[0] == 1
    write(tree, "maize", "A x+y__S1", 3, ["Location;Year;Yield", "3;2000;8.5"])
    # A former entry survives an experiment that has gone bad.
    write(tree, "wheat", "2020-01__01", 8, ["other", "1"])
    out = run(spark, tree, store)
    assert out["maize", "A x+y__S1"].status == "written" and out["wheat", "2020-01__01"].status == "error"
    second = {r.exp_id: r.release for r in manifest.read_manifest(spark, str(store)).collect()}
    assert second["2020-01__01"] == first["2020-01__01"] and second["A x+y__S1"] != first["A x+y__S1"]
    assert seen(spark, store) == sorted([*before, ("maize", "A x+y__S1", 3, 2000, 8.5)])
    assert seen(spark, store, 1) == before
    assert run(spark, tree, store, force=True)["maize", "A x+y__S1"].status == "written" and manifest.latest(spark, str(store))[0] == 3


def test_an_interrupted_run_leaves_the_former_version(spark, tree, monkeypatch):
    store = tree / "store"
    run(spark, tree, store)
    before = seen(spark, store)
    write(tree, "maize", "A x+y__S1", 1, ["Location;Year;Yield", "1;1999;0.5"])

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(manifest, "create_version", stopped)
        with pytest.raises(KeyboardInterrupt):
            run(spark, tree, store)
    assert seen(spark, store) == before and len(list((store / "data").glob("release=*"))) == 2
    assert run(spark, tree, store)["maize", "A x+y__S1"].status == "written"
    assert ("maize", "A x+y__S1", 1, 1999, 0.5) in seen(spark, store) and len(seen(spark, store)) == 3


def test_lost_races_are_retried_on_the_other_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    entry = "crop string, exp_id string, newest_source long, release string"
    manifest.publish(spark, root, spark.createDataFrame([("a", "1", 5, "old"), ("b", "1", 5, "old")], entry), KEYS)
    first, raced = manifest.create_version, []

    def slow(spark_, root_, number, snapshot):
        if not raced:
            raced.append(number)
            # Meanwhile another run publishes an older "a" and a newer "b".
            manifest.publish(spark, root, spark.createDataFrame([("a", "1", 6, "theirs"), ("b", "1", 9, "theirs"), ("c", "1", 1, "theirs")], entry), KEYS)
        first(spark_, root_, number, snapshot)

    monkeypatch.setattr(manifest, "create_version", slow)
    assert manifest.publish(spark, root, spark.createDataFrame([("a", "1", 7, "ours"), ("b", "1", 8, "ours")], entry), KEYS) == 3
    got = {r.crop: r.release for r in manifest.read_manifest(spark, root).collect()}
    assert raced == [2] and got == {"a": "ours", "b": "theirs", "c": "theirs"}
    with pytest.raises(manifest.LostRace):
        first(spark, root, 3, "x")
    assert sorted(p.name for p in (tmp_path / "store" / "versions").iterdir() if p.name[0] not in "._") == [f"{n:010d}" for n in (1, 2, 3)]


def test_reading_before_the_first_version_is_an_error(spark, tmp_path):
    assert manifest.read_manifest(spark, str(tmp_path)) is None
    with pytest.raises(ValueError, match="no version"):
        manifest.read_data(spark, str(tmp_path), KEYS)


def test_other_releases_are_not_listed(spark, tree):
    run(spark, tree, tree / "store")
    (tree / "store" / "data" / "release=lost" / "crop=maize").mkdir(parents=True)
    (tree / "store" / "data" / "release=lost" / "crop=maize" / "part.parquet").write_text("no parquet at all")
    assert len(seen(spark, tree / "store")) == 4
