"""Runs registered queries and their SQL twins side by side.

    python tests/oracle.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else what differs."""
    rel = con.sql(sql)
    names = list(rel.columns)
    theirs = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first (ours, sql): {bad[0]}"
    kinds = {n: str(t) for n, t in zip(names, rel.types)}
    loose = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
             "DATE": "date"}
    odd = [f"{n}: {t} != {kinds[n]}" for n, t in df.dtypes if loose.get(kinds[n], t) != t or kinds[n] == "HUGEINT"
           or (kinds[n].startswith("DECIMAL") and not t.startswith("decimal"))]
    return f"TYPES {odd}" if odd else None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args()
    from quaverlake.plans import all_queries, all_sql
    from quaverlake.session import get_session
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                       "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    queries, sql = all_queries(), all_sql()
    failed = 0
    for name, run in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"no sql, {df.count()} rows"
        except Exception as exc:  # report and go on with the next query
            problem = note = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{name:34} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
