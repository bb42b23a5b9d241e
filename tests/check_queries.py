"""Run registered queries next to their SQL on the given tables.

    python tests/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from surcos.checks.all import QUERIES, SQL  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: [(v is not None, str(type(v)), v if v is not None else 0) for v in row]
    return sorted(columns), sorted(([_plain(r[i]) for i in order] for r in rows), key=key)


def kind(t: str) -> str:
    names = {"BIGINT": "I64", "HUGEINT": "HUGE", "INTEGER": "I32", "INT": "I32", "VARCHAR": "STRING"}
    return names.get(t.upper(), t.upper())


def compare(spark, con, sf: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf)
    columns, rows = df.columns, [tuple(r) for r in df.collect()]
    if name not in SQL:
        return None if rows else "no rows"
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    got = rows_of(columns, rows)
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    theirs = {d[0]: kind(str(d[1])) for d in result.description}
    for field in df.schema:
        mine, other = kind(field.dataType.simpleString()), theirs[field.name]
        if mine != other and {mine, other} & {"I32", "I64", "HUGE", "DOUBLE"}:
            print(f"   types differ: {name}.{field.name} {mine} {other}")
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows != {len(expected[1])}"
    for a, b in zip(got[1], expected[1]):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> int:
    from surcos.session import session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = session(master="local[8]", spark__sql__shuffle__partitions="8",
                    spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception:
            problem = traceback.format_exc()[-900:]
        bad += problem is not None
        note = "ok" if problem is None else "DIFF " + problem[:900]
        print(f"{name:28s} {time.time() - start:6.1f}s {'sql' if name in SQL else 'rows'} {note}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
