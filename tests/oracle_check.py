"""Run registered queries next to their SQL and report differences.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.6f}") + 0.0
    if type(x).__name__ == "Decimal":
        return float(x)
    if isinstance(x, int):
        return x
    return str(x)


def family(t):
    t = str(t).lower()
    for k, names in {
        "int": ("bigint", "int", "hugeint", "long", "short", "ubigint"), "double": ("double", "decimal", "float"),
        "string": ("varchar", "string"), "bool": ("bool",), "ts": ("timestamp",), "date": ("date",),
    }.items():
        if any(t.startswith(n) for n in names):
            return k
    return t


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names, types = [d[0] for d in cur.description], [d[1] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    right = Counter(tuple(norm(r[i]) for i in pos) for r in cur.fetchall())
    if left != right:
        a, b = list((left - right).items())[:2], list((right - left).items())[:2]
        return f"rows {sum(left.values())} vs {sum(right.values())}; {cols} spark-only {a} sql-only {b}"
    st = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    bad = [(c, st[c], family(types[names.index(c)])) for c in cols if st[c] != family(types[names.index(c)])]
    if bad:
        return f"types {bad}"
    return None


def main():
    from callstrata.plans import catalog
    from callstrata.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for n in names:
        t = time.time()
        try:
            if n in catalog.ORACLES:
                msg = compare(spark, con, catalog.QUERIES[n], catalog.ORACLES[n], sf)
                tag = "ok" if msg is None else "DIFF " + msg
            else:
                tag = f"rows-only {catalog.QUERIES[n](spark, sf).count()}"
                msg = None
        except Exception as e:
            msg = tag = "ERR " + str(e).strip()[:600]
        bad += msg is not None
        print(f"{n:28s} {time.time() - t:6.2f}s {tag}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
