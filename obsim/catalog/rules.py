"""Queries for table-quality rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import dates as D
from ..functions import numeric as N
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import quality as Q
from ..plans.diagnose import LATITUDE_BANDS
from . import roles
from .aggregates import phen
from .registry import query, rnd, rounded
from .roles import PHEN_SQL, TABLES_SQL

_PREV = f"""{TABLES_SQL}, p AS (SELECT *, lag(value) OVER w AS pv, lag(idx) OVER w AS pidx FROM elements WINDOW w AS (PARTITION BY set_id ORDER BY idx))"""


@query("rule_bounds", "QLT-1", f"""
WITH {TABLES_SQL} SELECT 'bounds' AS rule, set_id, idx, {rnd('value')} AS value, 5e0 AS low, 45e0 AS high FROM elements WHERE value < 5 OR value > 45""")
def _(t):
    return rounded(Q.check_bounds(roles.elements(t), ["set_id"], "idx", "value", low=5, high=45))


@query("rule_bounds_from_table", "QLT-1 FN-M4", f"""
WITH {TABLES_SQL}, b AS (SELECT set_id, idx, least(value * 5e-1, value) AS low, greatest(least(value * 2e0, 6e1), value) AS high FROM elements),
n AS (SELECT l_orderkey AS set_id, l_linenumber AS idx, max(l_quantity) * 12e-1 AS value FROM lineitem GROUP BY 1, 2)
SELECT 'bounds' AS rule, set_id, idx, {rnd('value')} AS value, {rnd('low')} AS low, {rnd('high')} AS high FROM n JOIN b USING (set_id, idx) WHERE value < low OR value > high""")
def _(t):
    b = roles.elements(t).select("set_id", "idx", N.value_bounds("value", clip_to=(0.0, 60.0)).alias("b")).select("set_id", "idx", "b.*")
    now = t.lineitem.groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("idx")).agg(
        (F.max("l_quantity") * 1.2).alias("value")
    )
    return rounded(Q.check_bounds(now, ["set_id"], "idx", "value", bounds=b))


@query("rule_smooth", "QLT-2", f"""
WITH {_PREV} SELECT 'smooth' AS rule, set_id, idx, pidx AS prev_idx, {rnd('greatest(pv, value) / least(pv, value)')} AS step
FROM p WHERE pv IS NOT NULL AND greatest(pv, value) / least(pv, value) > 4""")
def _(t):
    return rounded(Q.check_smooth(roles.elements(t), ["set_id"], "idx", "value", 4.0))


@query("rule_monotone", "QLT-3", f"""
WITH {_PREV} SELECT 'monotone' AS rule, set_id, idx, pidx AS prev_idx, {rnd('value - pv')} AS delta FROM p WHERE value - pv < -10""")
def _(t):
    return rounded(Q.check_monotone(roles.elements(t), ["set_id"], "idx", "value", tolerance=10.0))


@query("rule_monotone_from_position", "QLT-4", f"""
WITH {TABLES_SQL}, p AS (SELECT *, lag(value) OVER w AS pv, lag(idx) OVER w AS pidx FROM elements WHERE x >= 5e-2 WINDOW w AS (PARTITION BY set_id ORDER BY idx))
SELECT 'monotone' AS rule, set_id, idx, pidx AS prev_idx, {rnd('value - pv')} AS delta FROM p WHERE value - pv > 5""")
def _(t):
    return rounded(Q.check_monotone(
        roles.elements(t), ["set_id"], "idx", "value", "non_increasing", 5.0, position="x", from_x=0.05
    ))


_ENDS = f"""{TABLES_SQL}, e AS (SELECT set_id, arg_max(value, idx) AS last, arg_min(value, idx) AS first, max(idx) AS li, count(*) AS n FROM elements GROUP BY 1)"""


@query("rule_endpoint_last_le_max", "QLT-5", f"""
WITH {_ENDS}, m AS (SELECT set_id, last, n, max(CASE WHEN idx < li THEN value END) AS lim FROM elements JOIN e USING (set_id) GROUP BY 1, 2, 3)
SELECT 'last_le_max' AS rule, set_id, {rnd('last')} AS last_value, {rnd('lim')} AS "limit" FROM m WHERE n > 1 AND last > lim + 1""")
def _(t):
    return rounded(Q.check_endpoint(roles.elements(t), ["set_id"], "idx", "value", tolerance=1.0))


@query("rule_endpoint_last_le_first", "QLT-5", f"""
WITH {_ENDS} SELECT 'last_le_first' AS rule, set_id, {rnd('last')} AS last_value, {rnd('first')} AS "limit" FROM e WHERE last > first + 1""")
def _(t):
    return rounded(Q.check_endpoint(roles.elements(t), ["set_id"], "idx", "value", "last_le_first", 1.0))


# Two members per set whose values sum to 1 before; afterwards one node of each set moves.
_CLOSE = f"""{TABLES_SQL}, n AS (SELECT set_id, idx, (value - floor(value / 1e1) * 1e1) / 1e1 AS v FROM elements),
a AS (SELECT set_id, idx, v AS a0, 1 - v AS b0, CASE WHEN idx = 3 THEN v + 1e-1 WHEN idx = 4 THEN v + 1e-3 ELSE v END AS a1 FROM n)"""


@query("rule_closure", "QLT-6", f"""
WITH {_CLOSE} SELECT 'closure' AS rule, set_id, CAST(idx AS INTEGER) AS node, {rnd('a0 + b0')} AS before_total, {rnd('a1 + b0')} AS total
FROM a WHERE abs(a1 + b0 - 1) > 5e-3""")
def _(t):
    v = (F.col("value") - F.floor(F.col("value") / 10.0) * 10.0) / 10.0
    base = roles.elements(t).select("set_id", F.col("idx").alias("node"), v.alias("v"))
    moved = F.when(F.col("node") == 3, F.col("v") + 0.1).when(F.col("node") == 4, F.col("v") + 0.001).otherwise(F.col("v"))

    def table(first):
        members = F.array(
            F.struct(F.lit("a").alias("member"), first.alias("v")), F.struct(F.lit("b").alias("member"), (1 - F.col("v")).alias("v"))
        )
        return base.select("set_id", "node", F.inline(members)).select("set_id", "member", "node", "v")

    out = Q.check_closure(table(F.col("v")), table(moved), ["set_id"], "member", "node", "v")
    return rounded(out)


_CHANGE = f"""{TABLES_SQL}, c AS (SELECT set_id, idx, x, value AS old, CASE WHEN (set_id + idx) % 3 = 0 THEN value * (1 + idx / 1e1) ELSE value END AS new FROM elements)"""


def changed(t):
    new = F.when((F.col("set_id") + F.col("idx")) % 3 == 0, F.col("value") * (1 + F.col("idx") / 10.0)).otherwise(F.col("value"))
    return roles.elements(t).withColumn("value", new)


@query("rule_max_changed", "QLT-7", f"""
WITH {_CHANGE} SELECT 'max_changed' AS rule, set_id, count(DISTINCT idx % 2) AS n_params, count(*) AS n_elements FROM c WHERE old <> new
GROUP BY 1, 2 HAVING count(DISTINCT idx % 2) > 1 OR count(*) > 2""")
def _(t):
    p = (F.col("idx") % 2).alias("param")
    before, after = roles.elements(t).select("*", p), changed(t).select("*", p)
    return Q.check_max_changed(before, after, ["set_id"], "param", "idx", "value", 1, 2)


@query("rule_step_limit", "QLT-8", f"""
WITH {_CHANGE} SELECT 'step' AS rule, set_id, idx, {rnd('old')} AS old, {rnd('new')} AS new, {rnd('abs(new - old) / abs(old)')} AS moved
FROM c WHERE abs(new - old) / abs(old) > 45e-2""")
def _(t):
    return rounded(Q.check_step(roles.elements(t), changed(t), ["set_id", "idx"], "value", 0.45))


@query("rule_key_ordering", "QLT-9", f"""
WITH {TABLES_SQL}, b AS (SELECT set_id, max(CASE WHEN idx = 1 THEN value END) AS a, max(CASE WHEN idx = 2 THEN value END) AS b FROM elements GROUP BY 1)
SELECT 'ordering' AS rule, set_id, {rnd('a')} AS left_value, {rnd('b')} AS right_value FROM b WHERE NOT (a < b)""")
def _(t):
    el = roles.elements(t).withColumn("name", F.concat(F.lit("P"), F.col("idx").cast("string")))
    return rounded(Q.check_ordering(el, ["set_id"], "name", "value", "P1", "<", "P2"))


@query("rule_protected_unchanged", "QLT-10", f"""
WITH {_CHANGE} SELECT 'protected' AS rule, set_id, idx, {rnd('old')} AS was, {rnd('new')} AS is_now FROM c WHERE abs(old - new) > 1e-9 AND x < 95e-3
UNION ALL SELECT 'protected', set_id, idx, {rnd('value')}, NULL FROM elements WHERE x >= 95e-3""")
def _(t):
    return rounded(Q.check_protected(
        roles.elements(t), changed(t).filter(F.col("x") < 0.095), ["set_id", "idx"], "value"
    ))


@query("snapshot_digests_equal", "QLT-10", """
SELECT l_orderkey % 20 AS part, count(*) AS n, bool_and(l_tax < 8e-2 OR l_linenumber < 7) AS same FROM lineitem GROUP BY 1""")
def _(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    now = t.lineitem.withColumn("part", F.col("l_orderkey") % 20)
    # A change in the seventh lines with the highest tax, written in another order of rows.
    changed = F.when((F.col("l_tax") >= 0.08) & (F.col("l_linenumber") >= 7), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    later = now.repartition("l_suppkey").withColumn("l_quantity", changed)
    a = Q.row_digests(now, ["part"], key, "l_quantity")
    b = Q.row_digests(later, ["part"], key, "l_quantity").withColumnsRenamed({"digest": "again", "n": "_n"})
    return a.join(b, "part").select("part", "n", (F.col("digest") == F.col("again")).alias("same"))


# Members are line statuses of an order at a node; an element can move when its value is above 5.
_SPACE = """sp AS (SELECT l_orderkey % 50 AS set_id, l_linestatus AS member, l_linenumber AS node, count(*) AS n, 0e0 AS low,
  CASE WHEN avg(l_quantity) > 25 THEN 1e0 ELSE 0e0 END AS high FROM lineitem GROUP BY 1, 2, 3)"""


def space(t):
    return t.lineitem.groupBy(
        (F.col("l_orderkey") % 50).alias("set_id"), F.col("l_linestatus").alias("member"), F.col("l_linenumber").alias("node")
    ).agg(F.lit(0.0).alias("low"), F.when(F.avg("l_quantity") > 25, 1.0).otherwise(0.0).alias("high"))


@query("elements_without_a_partner", "QLT-11", f"""
WITH {_SPACE}, g AS (SELECT set_id FROM sp GROUP BY 1 HAVING count(DISTINCT member) * count(DISTINCT node) = count(*)),
m AS (SELECT set_id, node FROM sp WHERE high - low > 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT set_id, member, node, low, high FROM sp WHERE high - low > 0 AND set_id IN (SELECT set_id FROM g) AND (set_id, node) IN (SELECT set_id, node FROM m)""")
def _(t):
    return Q.locked_elements(space(t), ["set_id"], "member", "node")


@query("space_without_protected", "QLT-12", f"""
WITH {_SPACE} SELECT set_id, member, node FROM sp WHERE (member, node) NOT IN (SELECT DISTINCT l_linestatus, l_linenumber FROM lineitem WHERE l_quantity = 7 AND l_linenumber <= 3)""")
def _(t):
    frozen = t.lineitem.filter((F.col("l_quantity") == 7) & (F.col("l_linenumber") <= 3)).select(
        F.col("l_linestatus").alias("member"), F.col("l_linenumber").alias("node")
    )
    return Q.offered_space(space(t), frozen, ["member", "node"]).select("set_id", "member", "node")


# ------------------------------------------------------------ scalar functions


@query("grid_ids", "FN-S1 FN-S2", """
SELECT c_custkey, concat('C', CAST(c_custkey % 97 AS VARCHAR), 'R', CAST(c_custkey % 41 AS VARCHAR)) AS grid_id,
       CAST(c_custkey % 97 AS INTEGER) AS grid_col, CAST(c_custkey % 41 AS INTEGER) AS grid_row FROM customer""")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", X.grid_id(k % 97, k % 41).alias("grid_id")).select(
        "*", X.grid_column("grid_id").alias("grid_col"), X.grid_row("grid_id").alias("grid_row")
    )


@query("experiment_id_parts", "FN-S3", """
SELECT o_orderkey, concat('A__', o_orderpriority) AS climate, o_orderstatus AS soil FROM orders""")
def _(t):
    e = F.concat(F.lit("A__"), F.col("o_orderpriority"), F.lit("__"), F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", X.before_last(e).alias("climate"), X.after_last(e).alias("soil"))


@query("masked_message_kinds", "FN-S4 AGG-32", """
SELECT role, regexp_replace(concat('turn ', CAST(turn AS VARCHAR), ' took ', CAST(length(text) / 1e1 AS VARCHAR), ' of -', CAST(conv_id AS VARCHAR), 'e+3 units '),
       '-?\\d+(\\.\\d+)?([eE][-+]?\\d+)?', '#', 'g') || '' AS raw_kind, count(*) AS n FROM conversations GROUP BY 1, 2""".replace(
    "' units ')", "' units')").replace("'e+3 units ')", "'e+3 units')"))
def _(t):
    s = F.concat(
        F.lit(" turn "), F.col("turn").cast("string"), F.lit(" took "), (F.length("text") / 10.0).cast("string"),
        F.lit(" of -"), F.col("conv_id").cast("string"), F.lit("e+3 units "),
    )
    df = t.conversations.select("role", X.mask_numbers(s).alias("raw_kind"))
    return A.message_kinds(df, ["role"], "raw_kind")


@query("masked_document_lines", "FN-S4", """
SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?', '#', 'g'), ' ') AS kind FROM documents""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", X.mask_numbers("line").alias("kind"))


@query("limit_breach_kinds", "FN-S5 AGG-32", """
SELECT l_suppkey, CASE WHEN l_linenumber = 1 THEN 'checkLimits' ELSE 'checkResult' END AS method,
       CASE WHEN l_linenumber = 1 THEN concat('value outside limits [', CAST(l_suppkey % 3 AS VARCHAR), ', ', CAST(l_suppkey % 3 + 10 AS VARCHAR), ']') ELSE 'line # of # failed' END AS kind,
       count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _(t):
    method = F.when(F.col("l_linenumber") == 1, "checkLimits").otherwise("checkResult")
    lo = (F.col("l_suppkey") % 3).cast("string")
    hi = (F.col("l_suppkey") % 3 + 10).cast("string")
    text = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_quantity").cast("string"), F.lit(" failed"))
    df = t.lineitem.select("l_suppkey", method.alias("method"), X.message_kind(method, text, lo, hi).alias("kind"))
    return A.message_kinds(df, ["l_suppkey", "method"])


@query("human_sizes", "FN-S6", """
WITH b AS (SELECT doc_id, CAST(pow(n_chars, 1 + doc_id % 4) AS DOUBLE) AS b FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN format('{:,.1f} B', b) WHEN b < pow(1024, 2) THEN format('{:,.1f} KiB', b / 1024) WHEN b < pow(1024, 3) THEN format('{:,.1f} MiB', b / pow(1024, 2))
  WHEN b < pow(1024, 4) THEN format('{:,.1f} GiB', b / pow(1024, 3)) ELSE format('{:,.1f} TiB', b / pow(1024, 4)) END AS size FROM b""")
def _(t):
    b = F.pow(F.col("n_chars").cast("double"), 1 + F.col("doc_id") % 4)
    return t.documents.select("doc_id", X.human_bytes(b).alias("size"))


@query("path_parts", "FN-S7", """
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, TRY_CAST(split_part(regexp_extract(concat('/data/', CAST(2000 + page_id % 30 AS VARCHAR), '_crop.gpkg'), '([^/]*)$', 1), '_', 1) AS INTEGER) AS year FROM pages""")
def _(t):
    name = F.concat(F.lit("/data/"), (F.lit(2000) + F.col("page_id") % 30).cast("string"), F.lit("_crop.gpkg"))
    return t.pages.select("page_id", X.base_name("url").alias("base"), X.year_token(name).alias("year"))


@query("squeezed_labels", "FN-S8", """
SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS squeezed, replace(role || '_' || 'name', '_', ' ') AS label FROM conversations""")
def _(t):
    return t.conversations.select(
        "conv_id", "turn", X.squeeze("text").alias("squeezed"), X.label(F.concat("role", F.lit("_name"))).alias("label")
    )


@query("list_digests", "FN-S9", """
SELECT c_nationkey, substr(sha1(string_agg(DISTINCT c_mktsegment, chr(10) ORDER BY c_mktsegment)), 1, 8) AS digest FROM customer GROUP BY 1""")
def _(t):
    # Market segments are a short fixed list, so the set stays small for any group.
    return t.customer.groupBy("c_nationkey").agg(X.list_digest(F.collect_set("c_mktsegment")).alias("digest"))


@query("date_parts", "FN-D1 FN-D7", f"""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
       {rnd('year(o_orderdate) + (month(o_orderdate) - 5e-1) / 12e0')} AS dec FROM orders""")
def _(t):
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return rounded(t.orders.select(
        "o_orderkey", y.alias("y"), m.alias("m"), F.dayofyear("o_orderdate").alias("doy"), D.decimal_year(y, m).alias("dec")
    ))


@query("dates_from_text_and_doy", "FN-D2 FN-D3 FN-D4 FN-D5", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_dmy, CAST(o_orderdate AS DATE) AS from_yj,
       CAST(o_orderdate AS DATE) AS from_doy, make_date(year(o_orderdate), 1, 1) AS first, make_date(year(o_orderdate) + 1, 12, 31) AS last FROM orders""")
def _(t):
    dmy = F.when(F.col("o_orderkey") % 7 == 0, "31.02.x").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    y, doy = F.year("o_orderdate"), F.dayofyear("o_orderdate")
    return t.orders.select(
        "o_orderkey", D.parse_day_month_year(dmy).alias("from_dmy"),
        D.parse_year_doy(F.date_format("o_orderdate", "yyyyDDD")).alias("from_yj"), D.date_of(y, doy).alias("from_doy"),
        D.window_start(y).alias("first"), D.window_end(y, 1).alias("last"),
    )


@query("harvest_years", "FN-D6", """
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(year(l_shipdate) AS INTEGER) + CASE WHEN l_suppkey % 2 = 0 AND l_linenumber <= 2 THEN 1 ELSE 0 END AS harvest_year FROM lineitem""")
def _(t):
    crop = F.when(F.col("l_suppkey") % 2 == 0, "winter_rapeseed").otherwise("potato")
    phase = F.when(F.col("l_linenumber") == 1, "sowing").when(F.col("l_linenumber") == 2, "emergence").otherwise("flowering")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", D.harvest_year(F.year("l_shipdate"), crop, phase).alias("harvest_year"))


@query("fixed_edge_bins", "FN-B1", """
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 40 THEN 2 END AS INTEGER) AS bin FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", N.edge_bin("l_quantity", [5, 10, 20, 40]).alias("bin"))


@query("equal_width_latitude_bands", "FN-B2 PIP-14", f"""
WITH {PHEN_SQL}, s AS (SELECT min(lat) AS lo, max(lat) AS hi FROM phen),
b AS (SELECT flowering_doy_sim - flowering_doy AS r, CAST(greatest(1, least(4, ceil((lat - lo) * 4 / (hi - lo)))) AS INTEGER) AS band FROM phen, s)
SELECT band, count(*) AS n, quantile_cont(r, 0.5) AS bias FROM b GROUP BY 1""")
def _(t):
    df = phen(t).withColumn("r", F.col("flowering_doy_sim") - F.col("flowering_doy"))
    return A.latitude_bands(df, "lat", "r", LATITUDE_BANDS)


@query("half_even_rounding_and_clip", "FN-M2 FN-M3", """
SELECT l_orderkey, l_linenumber, l_suppkey, round_even(l_quantity / 2e0, 0) AS half, greatest(1e1, least(4e1, l_quantity)) AS clipped FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", N.half_even(F.col("l_quantity") / 2.0).alias("half"),
        N.clip("l_quantity", 10.0, 40.0).alias("clipped"),
    )


@query("value_bounds", "FN-M4", """
WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0e0 ELSE c_acctbal END AS v FROM customer)
SELECT c_custkey, CASE WHEN v = 0 THEN 0e0 ELSE least(greatest(least(v * 5e-1, v * 2e0), -5e2), v) END AS low,
       CASE WHEN v = 0 THEN 0e0 ELSE greatest(least(greatest(v * 5e-1, v * 2e0), 8e3), v) END AS high,
       least(-1e3, v) AS abs_low, greatest(9e3, v) AS abs_high FROM v""")
def _(t):
    v = F.when(F.col("c_custkey") % 10 == 0, 0.0).otherwise(F.col("c_acctbal"))
    rel = N.value_bounds(v, clip_to=(-500.0, 8000.0))
    ab = N.value_bounds(v, mode="absolute", low=-1000.0, high=9000.0)
    return t.customer.select(
        "c_custkey", rel["low"].alias("low"), rel["high"].alias("high"), ab["low"].alias("abs_low"), ab["high"].alias("abs_high")
    )


@query("finite_pairs", "FN-M5", """
SELECT l_suppkey, count(*) FILTER (WHERE l_linenumber NOT IN (1, 2, 3)) AS n FROM lineitem GROUP BY 1""")
def _(t):
    n = F.col("l_linenumber")
    x = F.when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, F.lit(None).cast("double")).otherwise(F.col("l_quantity"))
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(N.finite_pair(x, "l_extendedprice")).alias("n"))


@query("array_edits_and_changes", "FN-A2 FN-A3", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)
SELECT vec_id, {r} AS edited_sum, CASE WHEN vec_id % 2 = 0 THEN [2, 5] ELSE [5] END AS indices, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS n_changed FROM e""".replace(
    "{r}", rnd("list_sum(a) - a[6] + 9 + CASE WHEN vec_id % 2 = 0 THEN 1 - a[3] ELSE 0 END")))
def _(t):
    a = F.transform("embedding", lambda x: x.cast("double"))
    even = F.col("vec_id") % 2 == 0
    edits = F.when(even, F.create_map(F.lit("2"), F.lit(1.0), F.lit("5"), F.lit(9.0))).otherwise(F.create_map(F.lit("5"), F.lit(9.0)))
    df = t.embeddings.select("vec_id", a.alias("a"), edits.alias("e")).withColumn("b", AR.edit_at("a", "e"))
    idx = AR.changed_indices("a", "b")
    return rounded(df.select(
        "vec_id", F.aggregate("b", F.lit(0.0), lambda s, x: s + x).alias("edited_sum"), idx.alias("indices"), F.size(idx).alias("n_changed")
    ))


@query("json_object_in_reply", "FN-J1", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(props->>'$.k' AS INTEGER) END AS k FROM events""")
def _(t):
    e, p = F.col("event_id") % 5, F.col("props")
    text = (
        F.when(e == 0, p).when(e == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```\nDone {ok}")))
        .when(e == 2, F.concat(F.lit("I propose "), p, F.lit(" as the next step {maybe}")))
        .when(e == 3, F.concat(F.lit("  "), p, F.lit("\n"))).otherwise(F.lit("no object { here"))
    )
    return t.events.select("event_id", F.get_json_object(X.json_in_text(text), "$.k").cast("int").alias("k"))


@query("proposal_shapes", "FN-J2", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 'P' END AS parameter, CASE event_id % 5 WHEN 0 THEN props->>'$.k' WHEN 1 THEN props->>'$.k'
  WHEN 2 THEN concat('{"2":', props->>'$.k', '}') WHEN 3 THEN concat('{"2":', props->>'$.k', '}') END AS value FROM events""")
def _(t):
    e = F.col("event_id") % 5
    k = F.get_json_object("props", "$.k")
    reply = (
        F.when(e == 0, F.concat(F.lit('{"parameter_changes":{"P":'), k, F.lit("}}")))
        .when(e == 1, F.concat(F.lit('{"parameter":"P","value":'), k, F.lit("}")))
        .when(e == 2, F.concat(F.lit('{"parameter":"P","index":2,"new_value":'), k, F.lit("}")))
        .when(e == 3, F.concat(F.lit('{"parameter":"P","parameter_changes":{"2":'), k, F.lit("}}")))
        .otherwise(F.lit('{"analysis":"none"}'))
    )
    return t.events.select("event_id", F.explode_outer(X.proposal_changes(reply)).alias("parameter", "value"))


@query("records_as_json", "FN-J3", """
SELECT l_returnflag, CAST(count(*) AS VARCHAR) AS n, NULL::VARCHAR AS bad FROM lineitem GROUP BY 1""")
def _(t):
    g = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.lit(float("nan")).alias("bad"))
    j = F.to_json(F.struct("n", N.finite_or_null("bad").alias("bad")))
    return g.select("l_returnflag", F.get_json_object(j, "$.n").alias("n"), F.get_json_object(j, "$.bad").alias("bad"))


@query("in_range_tri_state", "FN-C2", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal BETWEEN 1e3 AND 5e3 END AS ok FROM customer""")
def _(t):
    lo = F.when(F.col("c_mktsegment") == "BUILDING", 1000.0)
    hi = F.when(F.col("c_mktsegment") == "BUILDING", 5000.0)
    return t.customer.select("c_custkey", N.in_range("c_acctbal", lo, hi).alias("ok"))
