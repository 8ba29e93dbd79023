"""Run registered queries next to their SQL twins in DuckDB and compare values.

``python tests/oracle_check.py [--sf DIR] [key ...]``
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = _rows(cols, cur.fetchall())
    duck_took = time.time() - t
    problems = []
    if mine[0] != theirs[0]:
        problems.append(f"columns {mine[0]} vs {theirs[0]}")
    elif len(mine[1]) != len(theirs[1]):
        problems.append(f"rows {len(mine[1])} vs {len(theirs[1])}")
    if mine[0] == theirs[0] and mine[1] != theirs[1]:
        bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
        problems.append(f"{len(bad)} differing rows, e.g. {bad[:2]}")
        if bad:
            for n, x, y in zip(mine[0], *bad[0]):
                if x != y:
                    problems.append(f"   {n}: spark {str(x)[:200]!r} duck {str(y)[:200]!r}")
    return len(mine[1]), took, duck_took, problems


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = duck(args.sf)
    qs, oracle = entry.queries(), entry.oracle_sql()
    keys = args.keys or list(qs)
    failed = []
    for key in keys:
        if any(c in key for c in "*"):
            continue
        try:
            if key in oracle:
                n, a, b, problems = compare(spark, con, qs[key], oracle[key], args.sf)
                print(f"{'OK  ' if not problems else 'FAIL'} {key:20s} rows={n:<8d} spark={a:.2f}s duck={b:.2f}s")
            else:
                t = time.time()
                n, problems = qs[key](spark, args.sf).count(), []
                print(f"rows {key:20s} rows={n:<8d} spark={time.time() - t:.2f}s")
        except Exception as e:  # report and go on with the next key
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
            print("FAIL", key)
        for p in problems:
            print("     ", p[:1500])
        if problems:
            failed.append(key)
    print(f"{len(keys) - len(failed)}/{len(keys)} ok", "failed:" if failed else "", *failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
