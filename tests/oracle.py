"""Runs registered queries against DuckDB on the same files and compares rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "null"
        return "f:" + f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v.normalize():f}"
    if isinstance(v, dt.datetime):
        return "t:" + v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return "t:" + dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"s:{v}"


def compare(spark, con, q, sf_dir: str):
    t0 = time.time()
    df = q(spark, sf_dir)
    cols = df.columns
    rows = df.collect()
    spent = time.time() - t0
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    mine = sorted(tuple(canon(r[i]) for i in order) for r in rows)
    if q.sql is None:
        return ("rows-only", len(mine), None, spent, "")
    t1 = time.time()
    cur = con.execute(q.sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    duck = time.time() - t1
    if sorted(ocols) != sorted(cols):
        return ("COLUMNS", len(mine), len(orows), spent, f"{sorted(cols)} vs {sorted(ocols)}")
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    theirs = sorted(tuple(canon(r[i]) for i in oorder) for r in orows)
    if mine == theirs:
        return ("ok" if mine else "ok-EMPTY", len(mine), len(theirs), spent, f"duck {duck:.2f}")
    a, b = set(mine), set(theirs)
    return ("MISMATCH", len(mine), len(theirs), spent,
            f"cols {sorted(cols)}\n   spark-only {sorted(a - b)[:3]}\n   sql-only   {sorted(b - a)[:3]}")


def main(argv: list[str]) -> int:
    from ledgerline.plans import load
    from ledgerline.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name, q in load().items():
        if argv and not any(name == a or name.startswith(a) for a in argv):
            continue
        try:
            status, n, m, spent, note = compare(spark, con, q, sf)
        except Exception as exc:  # report and go on to the next query
            status, n, m, spent, note = "ERROR", None, None, 0.0, f"{type(exc).__name__}: {str(exc)[:500]}"
        flag = "" if status in ("ok", "rows-only") else "  <<<<"
        bad += bool(flag)
        print(f"{name:44s} {status:10s} spark={n} sql={m} {spent:5.1f}s {note}{flag}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
