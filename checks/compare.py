"""Run registered queries in Spark and DuckDB and compare them as multisets of rows.

Usage: python -m checks.compare <sf_dir> [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def typed(v):
    return (type(v).__name__, repr(v))


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(typed(cell(r[i])) for i in order) for r in rows)


def difference(name, spark, sf_dir, query, sql, con) -> str | None:
    df = query(spark, sf_dir)
    got_cols, got = bag(df.columns, df.collect())
    con.execute(sql)
    cols = [d[0] for d in con.description]
    want_cols, want = bag(cols, con.fetchall())
    if got_cols != want_cols:
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    if got != want:
        extra, missing = got - want, want - got
        pick = lambda c: [tuple(x[1] for x in r) for r in sorted(c, key=str)[:2]]
        return (f"rows {sum(got.values())} vs {sum(want.values())}; {sum(extra.values())} differ; cols {got_cols}\n"
                f"   spark  {pick(extra)}\n   duckdb {pick(missing)}\n   types {[x[0] for x in next(iter(extra or got))]} vs "
                f"{[x[0] for x in next(iter(missing or want))]}")
    return None


def main() -> int:
    from barlab.plans import ALL_QUERIES
    from barlab.session import local_session
    from checks.oracle import ORACLE_SQL

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(ALL_QUERIES)
    spark, con, bad = local_session(), connect(sf_dir), 0
    for n in names:
        if n not in ORACLE_SQL:
            print(f"{n:28s} no twin", flush=True)
            continue
        start = time.time()
        try:
            diff = difference(n, spark, sf_dir, ALL_QUERIES[n], ORACLE_SQL[n], con)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        print(f"{n:28s} {'ok' if diff is None else 'DIFF ' + diff} {time.time() - start:.1f}s", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
