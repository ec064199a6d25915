"""Compare named queries with their SQL twins: python tests/check_oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return "~" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows only ({len(got)})"
    rel = con.sql(sql)
    want_cols, want = normal(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = dict(zip(rel.columns, (str(t) for t in rel.types)))
    odd = [(c, t, theirs[c]) for c, t in df.dtypes if t in types and types[t] != theirs[c]]
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} vs {len(want)} rows; cols {got_cols}\n   spark {extra}\n   duck  {lack}"
    return True, f"{len(got)} rows" + (f"  TYPES {odd}" if odd else "")


def main():
    from recordloom.session import get_spark
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    con.execute("set TimeZone='UTC'")
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
