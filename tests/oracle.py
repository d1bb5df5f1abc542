"""Run registered queries against their oracle SQL in DuckDB and compare all rows.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from marketday.sources.standin import TEST_TABLES  # noqa: E402


SAME_TYPE = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TEST_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs: names, types, or rows (exact, as a multiset)."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: SAME_TYPE.get(str(d[1]), str(d[1])) for d in cursor.description}
    theirs = cursor.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for name, kind in df.dtypes:
        if kind != kinds[name]:
            return f"{name}: {kind} != {kinds[name]}"
    a, b = _rows(ours, df.columns), _rows(theirs, names)
    if a != b:
        return f"{len(ours)} rows vs {len(theirs)}; only ours {list((a - b).items())[:2]}; only theirs {list((b - a).items())[:2]}"
    return ""


def main(argv) -> int:
    from __spark_entry__ import oracle_sql, queries
    from marketday.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, todo, sql = connect(sf_dir), queries(), oracle_sql()
    bad = 0
    for name in argv[1:] or todo:
        start = time.time()
        try:
            df = todo[name](spark, sf_dir)
            if name in sql:
                said = compare(df, con, sql[name]) or "ok"
            else:
                said = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:700]}"
        if not said.startswith(("ok", "rows only")):
            bad += 1
        print(f"{name:34s} {time.time() - start:6.2f}s  {said[:900]}", flush=True)
    print(f"{bad} of {len(argv[1:] or todo)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
