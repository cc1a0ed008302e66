"""Runs registered queries in Spark and their SQL in DuckDB and compares rows and types.

    python tests/compare.py [--sf sf0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def connect(folder: str):
    import duckdb

    from worklake.bindings import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, make, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = make(spark, folder)
    cols = sorted(df.columns)
    got = _sorted([tuple(_cell(r[c]) for c in cols) for r in df.collect()])
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    if sorted(types) != cols:
        return f"columns {cols} vs {sorted(types)}"
    wrong = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]}
    if wrong:
        return f"types {wrong}"
    names = ", ".join(f'"{c}"' for c in cols)
    want = _sorted([tuple(_cell(v) for v in r) for r in con.execute(f"select {names} from ({sql})").fetchall()])
    if got != want:
        a, b = set(got), set(want)
        return (
            f"rows {len(got)} vs {len(want)}; columns {cols}\n  spark only {list(a - b)[:3]}\n"
            f"  sql only   {list(b - a)[:3]}"
        )
    return None if got else "empty"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="worklake-compare-"))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, make in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, folder, name, make, oracles[name])
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows only: {make(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            diff, note = "error", f"ERROR {str(e)[:900]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:36s} {time.time() - t:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
