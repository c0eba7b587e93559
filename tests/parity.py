"""Compare registered queries with their check statements in DuckDB.

Usage: python tests/parity.py [--sf 0.01] [--only name,name] [--time]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("f", float(value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def differences(spark_df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns: spark {sorted(spark_df.columns)} sql {sorted(names)}"]
    order = sorted(names)
    got = sorted((tuple(normal(r[c]) for c in order) for r in
                  ({k: v for k, v in row.asDict(recursive=True).items()} for row in spark_df.collect())), key=repr)
    positions = [names.index(c) for c in order]
    want = sorted((tuple(normal(r[i]) for i in positions) for r in expected), key=repr)
    out = []
    if len(got) != len(want):
        out.append(f"rows: spark {len(got)} sql {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} rows differ; first {order}: spark {bad[0][0]} sql {bad[0][1]}")
    return out


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--skip-checked", action="store_true")
    args = parser.parse_args()
    from tests.session import session
    import __spark_entry__ as contract
    spark = session()
    folder = f"/root/testdata/sf{args.sf}"
    con = connect(folder)
    queries, sqls = contract.queries(), contract.oracle_sql()
    wanted = [n for n in args.only.split(",") if n] or list(queries)
    failures = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sqls:
                diff = differences(df, con, sqls[name])
            else:
                n = df.count()
                diff = [] if n else ["no rows"]
            note = "ok" if not diff else "FAIL " + "; ".join(diff)
        except Exception as e:  # noqa: BLE001
            diff = [str(e)]
            note = "ERROR " + type(e).__name__ + " " + str(e)[:1500]
        failures += bool(diff)
        print(f"{name:34s} {time.time() - start:6.2f}s {'' if name in sqls else '(rows only) '}{note}", flush=True)
    print(f"{len(wanted)} queries, {failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main())
