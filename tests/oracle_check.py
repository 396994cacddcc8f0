"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column match and value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = bool(os.environ.get("ORACLE_EXACT"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, build, sql, sf_dir, con):
    t0 = time.time()
    df = build(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(srows), oracle=None, spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    ok_cols = sorted(scols) == sorted(ocols)
    ok_vals = ok_cols and rows_of(scols, srows) == rows_of(ocols, orows)
    info = dict(name=name, rows=len(srows), oracle_rows=len(orows), cols=ok_cols, values=ok_vals, spark_s=round(t1 - t0, 2))
    if not ok_cols:
        info["spark_cols"] = sorted(scols)
        info["oracle_cols"] = sorted(ocols)
    elif not ok_vals:
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        sa, sb = set(a), set(b)
        info["only_spark"] = [x for x in a if x not in sb][:3]
        info["only_oracle"] = [x for x in b if x not in sa][:3]
        info["cols_sorted"] = sorted(scols)
    return info


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from verdikt.session import local_session

    spark = local_session(cores="*", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        try:
            info = compare(spark, name, qs[name], sqls.get(name), sf_dir, con)
        except Exception as e:  # report and go on
            info = dict(name=name, error=f"{type(e).__name__}: {str(e)[:400]}")
        if info.get("error") or info.get("values") is False or info.get("cols") is False:
            bad += 1
        print(info, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main()
