"""Run a registered query and its check SQL on the same tables and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return v


def close(mine, theirs, tolerance=2e-6):
    """Equal but for doubles one unit apart in the last rounded digit (a tie rounds either way)."""

    def order(rows):
        return sorted(rows, key=lambda r: (repr([x for x in r if not isinstance(x, float)]), [x for x in r if isinstance(x, float)]))

    for a, b in zip(order(mine), order(theirs)):
        for x, y in zip(a, b):
            near = isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(1.0, abs(x))
            if x != y and not near:
                return False
    return True


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    cols = sorted(df.columns)
    idx = [df.columns.index(c) for c in cols]
    mine = sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)
    if sql is None:
        return took, len(mine), "rows-only" if mine else "EMPTY"
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    if sorted(ocols) != cols:
        return took, len(mine), f"COLUMNS {cols} vs {sorted(ocols)}"
    oidx = [ocols.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in oidx) for r in cur.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return took, len(mine), f"ROWS {len(mine)} vs {len(theirs)}"
    if mine != theirs and close(mine, theirs):
        return took, len(mine), "ok"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
        return took, len(mine), f"VALUES {cols} {len(a - b)} differ:\n   spark {only_a}\n   sql   {only_b}"
    return took, len(mine), "ok" if mine else "EMPTY"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from splitclock.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    if names:
        chosen = [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    else:
        chosen = list(queries)
    bad = []
    for q in chosen:
        try:
            took, n, verdict = compare(spark, con, q, queries[q], oracles.get(q), sf_dir)
        except Exception as e:  # noqa: BLE001
            took, n, verdict = 0.0, 0, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if verdict not in ("ok", "rows-only"):
            bad.append(q)
        print(f"{q:34s} {n:8d} rows {took:7.2f}s  {verdict}", flush=True)
    print(f"{len(chosen)} queries, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
