"""Compare queries with their SQL in DuckDB on whole tables, the way the driver does."""

from __future__ import annotations

import glob
import math
import os
import re
import sys
from collections import Counter

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def norm(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:  # noqa: ANN001
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    more, less = got - want, want - got
    if not more and not less:
        return f"{sum(got.values())} rows equal"
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list(more)[:2]}; only there {list(less)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as e
    from folioflow.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    d = sys.argv[1]
    con, qs, sql = connect(d), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [q for q in qs if not re.match(r"p\d+_", q)]:
        t = time.time()
        try:
            df = qs[name](spark, d)
            said = differences(df, sql[name], con) if name in sql else f"rows {df.count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:250]}"
        print(f"{name:26} {time.time() - t:5.1f}s {'SQL' if name in sql else '   '} {said or 'ok'}", flush=True)
