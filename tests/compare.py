"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return f"{float(value):.6g}" if isinstance(value, decimal.Decimal) else str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.10g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def check(spark, folder, name, build, sql, con):
    start = time.time()
    df = build(spark, folder)
    got_names, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL ({took:.1f}s)"
    start = time.time()
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    oracle = time.time() - start
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} rows vs {len(want)}; only spark {extra}; only sql {lost}"
    return True, f"{len(got)} rows ({took:.1f}s, sql {oracle:.1f}s)"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tallyweave.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = build_session(), duck(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = check(spark, folder, name, build, oracle.get(name), con)
        except Exception as error:  # one failing query must not hide the others
            ok, note = False, str(error)[:1500]
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
