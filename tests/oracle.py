"""Compare registered queries with their oracle SQL on one folder of tables.

    python -m tests.oracle [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

import duckdb

from obsim.catalog.registry import TABLES

SF_DIR = "/root/testdata/sf0.01"

_FAMILY = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "double": "double", "float": "float",
    "string": "string", "date": "date", "timestamp": "timestamp", "boolean": "bool",
    "TINYINT": "int8", "SMALLINT": "int16", "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "bool",
}


def connect(folder: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, [str(x) for x in rel.types]))
    ours = dict(df.dtypes)
    problems = []
    if set(ours) != set(theirs):
        return [f"columns differ: spark {sorted(ours)} oracle {sorted(theirs)}"]
    for c, t in ours.items():
        a, b = _FAMILY.get(t, t), _FAMILY.get(theirs[c], theirs[c])
        if a != b and not (t.startswith("array") and theirs[c].endswith("[]")):
            problems.append(f"type of {c}: spark {t} oracle {theirs[c]}")
    cols = sorted(ours)
    def key(row):
        return tuple((v is None, str(type(v)), str(v)) for v in row)
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    quoted = ", ".join(f'"{c}"' for c in cols)
    b = sorted((tuple(_plain(v) for v in r) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), key=key)
    if len(a) != len(b):
        problems.append(f"rows: spark {len(a)} oracle {len(b)}; first spark {a[:2]} oracle {b[:2]}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(bad)} of {len(a)} rows differ; first spark {bad[0][0]} oracle {bad[0][1]}")
    if not a:
        problems.append("empty result")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from obsim.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default=SF_DIR)
    ap.add_argument("--slow", type=float, default=3.0)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    con = connect(a.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not a.names or any(n.startswith(p) for p in a.names)]
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, a.sf)
            if name in oracle:
                bad = compare(df, con, oracle[name])
            else:
                bad = [] if df.count() else ["empty result"]
        except Exception as exc:  # noqa: BLE001
            text = "".join(traceback.format_exception_only(exc))
            bad = [text[:600]]
        took = time.time() - t0
        if bad:
            failed += 1
            print(f"FAIL {name} ({took:.1f}s): " + " | ".join(bad)[:900], flush=True)
        elif took > a.slow:
            print(f"slow {name} {took:.1f}s", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
