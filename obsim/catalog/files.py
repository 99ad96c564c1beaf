"""Queries for sources and sinks: files derived from the tables, written and read back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators.aggregates import message_kinds
from ..plans import views as V
from ..session import scratch_path, stage
from ..sources import catalog as C
from ..sources import consolidate as K
from ..sources import manifest as M
from ..sources import scan as SN
from ..streaming import incremental as I
from . import roles
from .registry import query, rnd, rounded
from .roles import SIM_SQL

YEARLY = "Location bigint, Year int, HarvestDATE date, Yield_t_ha double, crop string, exp_id string"

_YEARLY_SQL = """yearly AS (
  SELECT o_custkey AS Location, CAST(year(o_orderdate) AS INTEGER) AS Year, CAST(o_orderdate AS DATE) AS HarvestDATE,
         o_totalprice / 5e4 AS Yield_t_ha, o_orderstatus AS crop, concat(o_orderpriority, '__S', CAST(o_custkey % 3 AS VARCHAR)) AS exp_id FROM orders)"""


def yearly(t):
    return t.orders.select(
        F.col("o_custkey").alias("Location"), F.year("o_orderdate").alias("Year"), F.col("o_orderdate").cast("date").alias("HarvestDATE"),
        (F.col("o_totalprice") / 50000.0).alias("Yield_t_ha"), F.col("o_orderstatus").alias("crop"),
        F.concat(F.col("o_orderpriority"), F.lit("__S"), (F.col("o_custkey") % 3).cast("string")).alias("exp_id"),
    )


def _experiment_files(df, path: str, mode: str = "error") -> str:
    """One file for each experiment and namespace, by a single job."""
    keys = ["crop", "exp_id", "namespace"]
    df.repartition(*keys).write.mode(mode).option("sep", ";").option("header", True).partitionBy(*keys).csv(path)
    return path


def _result_files(t, label: str, compression: str | None = None) -> str:
    path = scratch_path(t.spark, label)
    K.write_delimited(yearly(t), path, ";", compression=compression)
    return path


_TALLY_SQL = f"""WITH {_YEARLY_SQL}
SELECT Year, count(*) AS n, count(DISTINCT Location) AS n_locations, {rnd('sum(Yield_t_ha)', 3)} AS total, max(HarvestDATE) AS latest FROM yearly GROUP BY 1"""


def _tally(df):
    return rounded(df.groupBy("Year").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Location").alias("n_locations"), F.sum("Yield_t_ha").alias("total"),
        F.max("HarvestDATE").alias("latest"),
    ), 3)


@query("scan_result_files", "SRC-1 SRC-3 SRC-4 SNK-1", _TALLY_SQL)
def _(t):
    path = _result_files(t, "results")
    return _tally(SN.scan_results(t.spark, path, YEARLY, columns=["Location", "Year", "HarvestDATE", "Yield_t_ha"]))


@query("scan_gzip_results", "SNK-2 SRC-6", _TALLY_SQL)
def _(t):
    return _tally(SN.scan_results(t.spark, _result_files(t, "pairs", "gzip"), YEARLY))


@query("scan_even_sample_of_files", "SRC-2", f"""
WITH {_YEARLY_SQL}, s AS (SELECT slot, row_number() OVER (ORDER BY CAST(slot AS VARCHAR)) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT Location % 16 AS slot FROM yearly)),
i AS (SELECT CAST(floor(i * ((SELECT max(n) - 1 FROM s) / 4e0)) AS BIGINT) AS pos FROM range(5) t(i))
SELECT count(DISTINCT Location % 16) AS n_files, count(*) AS n_rows, count(DISTINCT Location) AS n_locations FROM yearly
WHERE Location % 16 IN (SELECT slot FROM s WHERE r IN (SELECT pos FROM i))""")
def _(t):
    path = scratch_path(t.spark, "byplace")
    # One file per slot; the sample takes five files at even positions of the sorted names.
    yearly(t).withColumn("slot", F.col("Location") % 16).repartition("slot").write.partitionBy("slot").option(
        "sep", ";").option("header", True).csv(path)
    df = SN.scan_results(t.spark, path, YEARLY, sample=5, with_file=True)
    return df.agg(
        F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Location").alias("n_locations")
    )


@query("scan_commented_series", "SRC-5", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_extendedprice) / 2e2, 4) AS co2_ppm FROM lineitem GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "annual")
    # The value stands before the year, with a column in between that is not asked for.
    text = F.concat_ws(",", F.col("level").cast("string"), F.lit("x"), F.col("year").cast("string"))
    a = roles.annual(t).select(F.lit(2).alias("rank"), text.alias("value"))
    notes = t.region.select(F.lit(0).alias("rank"), F.concat(F.lit("# region "), F.col("r_name")).alias("value"))
    head = t.spark.createDataFrame([(1, "co2_ppm,flag,year")], "rank int, value string")
    # One row a year: a single small file.
    notes.unionByName(head).unionByName(a).coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)
    return SN.scan_commented(t.spark, path, "year int, co2_ppm double")


@query("scan_weather_by_source", "SRC-6", f"""
SELECT CASE WHEN o_custkey % 2 = 0 THEN 'obs' ELSE 'model' END AS source, CAST(o_custkey % 3 AS INTEGER) AS "vColumn", CAST(o_custkey % 2 AS INTEGER) AS "vRow",
       count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS rain FROM orders GROUP BY 1, 2, 3""")
def _(t):
    parts = []
    for source, rest, sep, zipped in (("obs", 0, "\t", "gzip"), ("model", 1, ",", "none")):
        folder = scratch_path(t.spark, source)
        # The cell stands in the path; Spark names the files themselves.
        for col in range(3):
            t.orders.filter((F.col("o_custkey") % 2 == rest) & (F.col("o_custkey") % 3 == col)).select(
                F.col("o_orderdate").cast("date").alias("Date"), F.col("o_totalprice").alias("Rain")
            ).write.option("sep", sep).option("header", True).option("compression", zipped).csv(f"{folder}/w_C{col}R{rest}.csv")
        parts.append((source, folder, sep))
    w = SN.scan_weather(t.spark, parts, "Date date, Rain double")
    return rounded(w.groupBy("source", "vColumn", "vRow").agg(F.count(F.lit(1)).alias("n"), F.sum("Rain").alias("rain")), 2)


@query("scan_grid_json", "SRC-7", """
SELECT c_custkey / 1e1 AS lat, CAST(c_nationkey AS DOUBLE) AS lon, CAST(c_custkey % 50 AS INTEGER) AS "row", CAST(c_nationkey AS INTEGER) AS col FROM customer""")
def _(t):
    path = scratch_path(t.spark, "grid")
    pair = F.array(
        F.array(F.col("c_custkey") / 10.0, F.col("c_nationkey").cast("double")),
        F.array((F.col("c_custkey") % 50).cast("double"), F.col("c_nationkey").cast("double")),
    )
    # One document per line; each is a list of coordinate pairs.
    t.customer.select(F.to_json(F.array(pair)).alias("value")).write.text(path)
    return SN.scan_grid_json(t.spark, path)


@query("scan_parameter_xml", "SRC-8", """
WITH w AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT concat('set', CAST(l_orderkey AS VARCHAR)) AS set_id, concat('P', CAST(l_linenumber AS VARCHAR)) AS param, CAST(i AS INTEGER) AS idx,
       CASE i WHEN 0 THEN max(l_quantity) ELSE max(l_quantity) + 1 END AS value
FROM lineitem, range(2) r(i) WHERE l_linenumber = 1 OR i = 0 GROUP BY 1, 2, 3, i""")
def _(t):
    path = scratch_path(t.spark, "xml")
    el = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    table = F.col("l_linenumber") == 1
    item = F.struct(
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("_id"),
        F.when(~table, F.col("q").cast("string")).alias("_VALUE"),
        F.when(table, F.array("q", F.col("q") + 1)).alias("value"),
    )
    sets = el.select("l_orderkey", item.alias("p")).groupBy("l_orderkey").agg(
        F.collect_list("p").alias("parameter")  # at most seven elements per set
    )
    sets.select(F.concat(F.lit("set"), F.col("l_orderkey").cast("string")).alias("_name"), "parameter").write.format("xml").option(
        "rootTag", "crops").option("rowTag", "crop").save(path)
    return SN.scan_params_xml(t.spark, path)


@query("scan_ledger_records", "SRC-9 SNK-6", """
SELECT CAST(event_id AS INTEGER) AS iteration, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS objective, TRY_CAST(props->>'$.k' AS VARCHAR) AS k FROM events""")
def _(t):
    path = scratch_path(t.spark, "ledger")
    rec = roles.ledger(t).select(
        F.col("iteration").cast("int").alias("iteration"), "status", "objective",
        F.from_json("props", "map<string,string>").alias("parameters_changed"),
    )
    K.append_records(rec.filter("iteration % 2 = 0"), path)
    K.append_records(rec.filter("iteration % 2 = 1"), path)
    return SN.scan_ledger(t.spark, path).select("iteration", "status", "objective", F.col("parameters_changed")["k"].alias("k"))


@query("scan_check_logs", "SRC-10 AGG-32 FN-S5", """
WITH l AS (SELECT CASE WHEN l_linenumber = 1 THEN 'checkLimits' ELSE 'checkResult' END AS method, concat('v', CAST(l_linenumber AS VARCHAR)) AS variable,
  CASE WHEN l_linenumber = 1 THEN concat('value outside limits [0, ', CAST(l_suppkey % 4 AS VARCHAR), ']') ELSE 'stage # at day #' END AS kind
  FROM lineitem WHERE l_linenumber <> 7)
SELECT method, variable, kind, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def _(t):
    path = scratch_path(t.spark, "checks")
    tab = F.lit("\t")
    n = F.col("l_linenumber")
    limits = F.concat(F.lit("checkLimits\ta\tb\tc\tv1\t"), F.col("l_quantity").cast("string"), F.lit("\t0\t"), (F.col("l_suppkey") % 4).cast("string"))
    text = F.concat(
        F.lit("checkResult\ta\tb\tc\tv"), n.cast("string"), tab, F.lit("stage "), F.col("l_tax").cast("string"), F.lit(" at day "),
        F.col("l_orderkey").cast("string"),
    )
    line = F.when(n == 1, limits).when(n == 7, F.lit("short\tline")).otherwise(text)
    head = t.spark.createDataFrame([
        ("Session 1 started",), ("CheckMethod\tDate\tComponent\tType\tVariableName\tAdditionalInformation\tMin\tMax",)
    ], "value string")
    head.unionByName(t.lineitem.select(line.alias("value"))).write.text(path)
    return SN.scan_check_log(t.spark, path).groupBy("method", "variable", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("file_catalog_of_runs", "SRC-11 FN-S3", f"""
WITH {_YEARLY_SQL}
SELECT crop, exp_id, regexp_replace(exp_id, '__.*$', '') AS climate, regexp_replace(exp_id, '^.*__', '') AS soil, true AS has_files, count(*) AS n_rows
FROM yearly WHERE exp_id LIKE '%__S0' OR exp_id LIKE '%__S1' GROUP BY 1, 2""")
def _(t):
    own = yearly(t).withColumn("namespace", F.col("exp_id"))
    # Trial runs have a namespace of their own, to be ignored.
    trial = own.filter(F.col("exp_id").endswith("S0")).withColumn("namespace", F.concat(F.lit("SMOKE_"), F.col("exp_id")))
    files = C.file_catalog(t.spark, _experiment_files(own.unionByName(trial), scratch_path(t.spark, "tree")), "*.csv")
    found = C.runs(files, soils=["S0", "S1"], layout=C.RUN_PARTITIONS).groupBy("crop", "exp_id", "climate", "soil").agg(
        (F.count(F.lit(1)) > 0).alias("has_files"))
    n = yearly(t).groupBy("crop", "exp_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(n, ["crop", "exp_id"])


@query("consolidated_experiments", "SNK-3 PIP-19 AGG-35", f"""
WITH {_YEARLY_SQL}
SELECT crop, exp_id, count(*) AS n_rows, count(DISTINCT Location) AS n_location_files FROM yearly GROUP BY 1, 2""")
def _(t):
    src = SN.scan_results(t.spark, _result_files(t, "many"), YEARLY)
    return K.consolidate(src, scratch_path(t.spark, "consolidated"), ["crop", "exp_id"], ["Location", "Year", "HarvestDATE"])


@query("consolidation_in_versions", "SNK-3 SNK-4 SNK-5 PIP-19 AGG-35", f"""
WITH {_YEARLY_SQL},
e AS (SELECT crop, exp_id, count(*) FILTER (crop = 'F' OR Year < 1998) AS n_rows, bool_or(crop = 'F' AND Year >= 1998) AS changed,
      bool_or(Year < 1998) AS before FROM yearly GROUP BY 1, 2)
SELECT crop, exp_id, CASE WHEN before THEN 'written' ELSE '' END AS first_status, CASE WHEN changed THEN 'written' ELSE 'skipped' END AS second_status,
  n_rows, n_rows AS n_rows_named, true AS has_bytes FROM e WHERE before OR changed
UNION ALL SELECT DISTINCT crop, 'twoHeads', '', 'error', 0, 0, false FROM yearly""")
def _(t):
    # Files of two namespaces, so that what the catalog leaves out is seen to stay out.
    src, store = scratch_path(t.spark, "experiments"), scratch_path(t.spark, "store")
    rows = yearly(t).withColumn("namespace", F.col("exp_id"))
    layout, order = C.RUN_PARTITIONS, ["Location", "Year", "HarvestDATE"]

    def run():
        files = C.runs(C.file_catalog(t.spark, src, "*.csv"), layout=layout)
        return stage(K.consolidate_release(t.spark, files, store, YEARLY, order, layout=layout), "run")

    _experiment_files(rows.filter("Year < 1998"), src)
    _experiment_files(rows.filter("Year < 1998").withColumn("namespace", F.concat(F.lit("SMOKE_"), F.col("exp_id"))), src, "append")
    first = run()
    # More files for one crop, and an experiment whose files disagree.
    _experiment_files(rows.filter("Year >= 1998 and crop = 'F'"), src, "append")
    bad = rows.withColumns({"exp_id": F.lit("twoHeads"), "namespace": F.lit("twoHeads")})
    _experiment_files(bad, src, "append")
    _experiment_files(bad.withColumnRenamed("Year", "Season"), src, "append")
    second = run()
    # What an interrupted run has written belongs to no version.
    lost = yearly(t).withColumn("release", F.lit("lost"))
    lost.write.mode("append").partitionBy("release", "crop", "exp_id").parquet(f"{store}/data")
    seen = M.read_data(t.spark, store, ["crop", "exp_id"]).groupBy("crop", "exp_id").agg(F.count(F.lit(1)).alias("n_rows"))
    named = M.read_manifest(t.spark, store).select("crop", "exp_id", F.col("n_rows").alias("n_rows_named"), (F.col("out_bytes") > 0).alias("has_bytes"))
    status = second.select("crop", "exp_id", F.col("status").alias("second_status")).join(
        first.select("crop", "exp_id", F.col("status").alias("first_status")), ["crop", "exp_id"], "left")
    return status.join(seen, ["crop", "exp_id"], "left").join(named, ["crop", "exp_id"], "left").select(
        "crop", "exp_id", F.coalesce("first_status", F.lit("")).alias("first_status"), "second_status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_rows_named")], F.coalesce("has_bytes", F.lit(False)).alias("has_bytes"),
    )


@query("headers_agree", "ASR-1", """
SELECT 'Location;Year;HarvestDATE;Yield_t_ha;crop;exp_id' AS header, count(*) AS n_rows FROM orders""")
def _(t):
    path = _result_files(t, "heads")
    names = K.assert_same_header(t.spark, path, "Location;")
    return SN.scan_results(t.spark, path, YEARLY).agg(F.lit(";".join(names)).alias("header"), F.count(F.lit(1)).alias("n_rows"))


@query("stale_experiments", "SNK-4", """
WITH s AS (SELECT o_orderstatus AS crop, o_orderpriority AS exp_id, max(o_orderdate) AS m FROM orders GROUP BY 1, 2),
w AS (SELECT o_orderstatus AS crop, o_orderpriority AS exp_id, max(o_orderdate) AS w FROM orders WHERE o_totalprice < 4e5 AND o_orderpriority <> '5-LOW' GROUP BY 1, 2)
SELECT crop, exp_id FROM s LEFT JOIN w USING (crop, exp_id) WHERE w IS NULL OR w < m""")
def _(t):
    src = t.orders.select(F.col("o_orderstatus").alias("crop"), F.col("o_orderpriority").alias("exp_id"), F.col("o_orderdate").alias("modified"))
    done = t.orders.filter((F.col("o_totalprice") < 4e5) & (F.col("o_orderpriority") != "5-LOW")).groupBy(
        F.col("o_orderstatus").alias("crop"), F.col("o_orderpriority").alias("exp_id")
    ).agg(F.max("o_orderdate").alias("written"))
    return K.stale_experiments(src, done, ["crop", "exp_id"])


_MANIFEST_SQL = """old AS (SELECT o_orderstatus AS crop, o_orderpriority AS exp_id, count(*) AS n_rows FROM orders WHERE year(o_orderdate) < 1998 AND o_orderpriority <> '1-URGENT' GROUP BY 1, 2),
new AS (SELECT o_orderstatus AS crop, o_orderpriority AS exp_id, count(*) AS n_rows, CASE o_orderpriority WHEN '1-URGENT' THEN 'written' WHEN '2-HIGH' THEN 'skipped' ELSE 'error' END AS status
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2)"""


def _manifests(t):
    keys = [F.col("o_orderstatus").alias("crop"), F.col("o_orderpriority").alias("exp_id")]
    old = t.orders.filter((F.year("o_orderdate") < 1998) & (F.col("o_orderpriority") != "1-URGENT")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("exp_id") == "1-URGENT", "written").when(F.col("exp_id") == "2-HIGH", "skipped").otherwise("error")
    new = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows")
    ).withColumn("status", status)
    return old, new


@query("manifest_upsert", "SNK-5", f"""
WITH {_MANIFEST_SQL}, ok AS (SELECT crop, exp_id, n_rows FROM new WHERE status IN ('written', 'skipped'))
SELECT * FROM ok UNION ALL SELECT * FROM old WHERE (crop, exp_id) NOT IN (SELECT crop, exp_id FROM ok)""")
def _(t):
    old, new = _manifests(t)
    return K.upsert_manifest(old, new, ["crop", "exp_id"])


@query("deletable_logs", "SNK-7", f"""
WITH {_MANIFEST_SQL}, logs AS (SELECT DISTINCT o_orderstatus AS crop, o_orderpriority AS exp_id FROM orders)
SELECT crop, exp_id FROM logs WHERE (crop, exp_id) IN (SELECT crop, exp_id FROM old) AND (crop, exp_id) NOT IN (SELECT crop, exp_id FROM new WHERE status = 'error')""")
def _(t):
    old, new = _manifests(t)
    logs = t.orders.select(F.col("o_orderstatus").alias("crop"), F.col("o_orderpriority").alias("exp_id")).distinct()
    return K.deletable_logs(logs, old, new.filter("status = 'error'"), ["crop", "exp_id"])


@query("run_per_variable", "PIP-22", """
WITH r AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'optim:B' ELSE c_mktsegment END AS label, max(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
v(variable, own) AS (VALUES ('phenology', 'optim:B'), ('lai', 'optim:X'), ('yield', 'MACHINERY')),
n AS (SELECT label FROM r WHERE NOT starts_with(label, 'optim:') ORDER BY m DESC, label DESC LIMIT 1)
SELECT variable, CASE WHEN own IN (SELECT label FROM r) THEN own ELSE (SELECT label FROM n) END AS run FROM v""")
def _(t):
    label = F.when(F.col("c_mktsegment") == "BUILDING", "optim:B").otherwise(F.col("c_mktsegment"))
    cat = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(label.alias("label"), F.col("o_orderdate").alias("modified"))
    v = t.spark.createDataFrame([("phenology", "optim:B"), ("lai", "optim:X"), ("yield", "MACHINERY")], "variable string, own string")
    return C.latest_run(cat, v)


@query("incremental_consolidation", "STR-1", f"""
WITH {_YEARLY_SQL}, b AS (SELECT *, CASE WHEN Year < 1998 THEN 0 ELSE 1 END AS batch_id FROM yearly)
SELECT crop, exp_id, CAST(batch_id AS INTEGER) AS batch_id, count(*) AS n_rows, count(DISTINCT Location) AS n_locations FROM b GROUP BY 1, 2, 3""")
def _(t):
    src, out, check = (scratch_path(t.spark, x) for x in ("arriving", "landed", "stream"))
    y = yearly(t)
    for part in (y.filter("Year < 1998"), y.filter("Year >= 1998")):
        part.write.mode("append").option("sep", ";").option("header", True).csv(src)
        # Each call takes in only what arrived since the last one.
        I.consolidate_stream(t.spark, src, out, YEARLY, check, ["crop", "exp_id", "Location"]).awaitTermination()
    return I.batch_manifest(I.read_consolidated(t.spark, out, YEARLY), ["crop", "exp_id"], "Location")


@query("incomplete_experiments", "STR-1", """
WITH f AS (SELECT o_orderpriority AS experiment, count(DISTINCT o_custkey % 8) AS seen FROM orders GROUP BY 1)
SELECT experiment, seen, seen + CASE WHEN experiment = '5-LOW' THEN 1 ELSE 0 END AS expected,
  CASE WHEN experiment = '5-LOW' THEN 'incomplete' ELSE 'complete' END AS status FROM f""")
def _(t):
    src, out, check = (scratch_path(t.spark, x) for x in ("tasks", "arrivals", "stream"))
    rows = t.orders.select(F.col("o_orderpriority").alias("exp_id"), (F.col("o_custkey") % 8).alias("task"), "o_orderkey")
    # One more task than files for one experiment.
    expected = stage(rows.groupBy(F.col("exp_id").alias("experiment")).agg(
        (F.count_distinct("task") + F.when(F.first("exp_id") == "5-LOW", 1).otherwise(0)).alias("expected")), "expected")
    for part in (rows.filter("exp_id <> '1-URGENT'"), rows.filter("exp_id = '1-URGENT'")):
        part.repartition("exp_id", "task").write.mode("append").partitionBy("exp_id", "task").option("header", True).csv(src)
        I.watch_arrivals(t.spark, src, "/exp_id=([^/]*)/", expected, out, check, wait_ms=300).awaitTermination()
        time.sleep(0.5)
    return I.arrival_status(t.spark, out)


@query("check_log_summary", "PIP-19 AGG-32", """
WITH m AS (SELECT l_returnflag AS crop, l_linestatus AS exp_id, CASE WHEN l_linenumber % 2 = 0 THEN 'low value #' ELSE 'high value # of #' END AS kind FROM lineitem)
SELECT crop, exp_id, kind, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def _(t):
    q = F.col("l_quantity").cast("string")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("low value "), q)).otherwise(
        F.concat(F.lit("high value "), q, F.lit(" of "), F.col("l_extendedprice").cast("string"))
    )
    df = t.lineitem.select(F.col("l_returnflag").alias("crop"), F.col("l_linestatus").alias("exp_id"), X.mask_numbers(text).alias("kind"))
    return message_kinds(df, ["crop", "exp_id"])


@query("non_empty_pairs", "ASR-2", f"WITH {SIM_SQL} SELECT count(*) AS n FROM sim")
def _(t):
    return R.assert_not_empty(roles.sim_yearly(t), "pairs").agg(F.count(F.lit(1)).alias("n"))


@query("empty_matches_are_errors", "ASR-2", f"""
WITH {SIM_SQL}
SELECT 'canopy pairs' AS view, 'no canopy pairs matched' AS message, (SELECT count(*) FROM sim) AS n UNION ALL
SELECT 'phenology pairs', 'no phenology pairs matched', (SELECT count(*) FROM sim) UNION ALL
SELECT 'yield pairs', 'no yield pairs matched', (SELECT count(*) FROM sim)""")
def _(t):
    # Observations of places that no simulation has: every score must refuse them.
    away = {c: F.lit(-1).cast("long") for c in ("location", "PointID")}
    canopy, phen = roles.obs_canopy(t), roles.obs_phenology(t)
    scores = {
        "canopy pairs": lambda: V.canopy_score(roles.daily_canopy(t), canopy.withColumns({c: v for c, v in away.items() if c in canopy.columns}), [0.0, 1.0, 2.0]),
        "phenology pairs": lambda: V.phenology_score(roles.sim_phenology(t), phen.withColumns({c: v for c, v in away.items() if c in phen.columns})),
        "yield pairs": lambda: V.yield_score(roles.sim_yearly(t), roles.points(t), roles.obs_yield(t).withColumn("NUTS_ID", F.lit("nowhere"))),
    }
    rows = []
    for view, score in scores.items():
        try:
            score()
            rows.append((view, "accepted"))
        except ValueError as error:
            rows.append((view, str(error)))
    n = roles.sim_yearly(t).agg(F.count(F.lit(1)).alias("n"))
    return t.spark.createDataFrame(rows, "view string, message string").crossJoin(n)
