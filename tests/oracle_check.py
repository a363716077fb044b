"""Run registered queries against their DuckDB oracles (same comparison the driver makes).

    python tests/oracle_check.py [sf_dir] [key-substring ...]

Prints one line per query: rows Spark/oracle, column match, value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[10:].strip("0: ") == "" else str(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


SPARK_TO_DUCK = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
                 "short": "SMALLINT", "binary": "BLOB"}


def type_diffs(sdf, rel) -> list[str]:
    duck_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.typeName(), f.dataType.simpleString().upper())
        got = duck_types.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark {want} vs duck {got}")
    return out


def compare(spark, con, key, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    undeclared = [f.name for f in sdf.schema.fields
                  if f.dataType.typeName() == "double" and f.name not in getattr(fn, "digits", {})]
    sp = sdf.toPandas()
    ts = time.time() - t
    if sql is None:
        return f"{key:38s} rows={len(sp):7d} (rows-only) {ts:6.1f}s", True
    t = time.time()
    rel = con.sql(sql)
    tdiff = type_diffs(sdf, rel)
    od = rel.df()
    to = time.time() - t
    sc, sr = rows_of(sp)
    oc, orr = rows_of(od)
    ok_cols = sc == oc
    ok_rows = len(sr) == len(orr)
    ok_vals = ok_cols and sr == orr
    msg = f"{key:38s} rows={len(sr):7d}/{len(orr):7d} cols={'ok' if ok_cols else 'DIFF'} vals={'ok' if ok_vals else 'DIFF'} {ts:6.1f}s/{to:5.1f}s"
    if undeclared:
        msg += f"  [unrounded doubles: {undeclared}]"
    if tdiff:
        msg += f"  [types: {'; '.join(tdiff)}]"
    if not ok_cols:
        msg += f"\n    spark cols {sc}\n    duck  cols {oc}"
    elif not ok_vals:
        diffs = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
        for a, b in diffs:
            msg += f"\n    spark {a}\n    duck  {b}"
    return msg, ok_cols and ok_rows and ok_vals and not tdiff


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    import __spark_entry__ as E
    if os.environ.get("PLAIN_SESSION"):
        # What a driver with default settings would hand us (1 GB driver heap, 200 shuffle partitions).
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    else:
        from adyield.session import build_session
        spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    skip = [p[1:] for p in pats if p.startswith("-")]
    pats = [p for p in pats if not p.startswith("-")]
    for key in sorted(qs):
        if pats and not any(p in key for p in pats):
            continue
        if any(p in key for p in skip):
            continue
        try:
            msg, ok = compare(spark, con, key, qs[key], sqls.get(key), sf_dir)
        except Exception as exc:  # report and continue
            msg, ok = f"{key:38s} ERROR {type(exc).__name__}: {str(exc)[:400]}", False
        bad += 0 if ok else 1
        print(msg, flush=True)
    print(f"done: {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
