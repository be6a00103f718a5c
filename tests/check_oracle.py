"""Run registered queries next to their SQL in DuckDB and compare the results.

Usage: python tests/check_oracle.py [--sf DIR] [--only PREFIX ...] [--time]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    data = [tuple(_norm(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(data, key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    gc, g = rows_of(got)
    wc, w = rows_of(want)
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ, cols {gc}, first: {bad[0][0]} != {bad[0][1]}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", nargs="*", default=[])
    args = ap.parse_args()
    from stageflow.plans import REGISTRY
    from stageflow.session import build_session

    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name, q in REGISTRY.items():
        if args.only and not any(name.startswith(p) for p in args.only):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, args.sf)
            got = df.toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(q.sql).df()
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            wt = {c: str(t) for c, t in want.dtypes.items()}
            err = compare(got, want)
            drift = [c for c in types if (types[c] in ("double",)) != (wt.get(c, "").startswith("float")) and types[c] in ("int", "bigint", "double") and not want[c].isna().any()] if not err else []
            odd = [c for c in types if types[c].startswith("decimal")]
        except Exception as e:  # noqa: BLE001
            err, drift, odd, t1 = f"{type(e).__name__}: {str(e)[:700]}", [], [], time.time()
        failed += bool(err)
        note = f" TYPES {drift}{odd}" if drift or odd else ""
        print(f"{'FAIL' if err else 'ok'} {name}: {err or f'{len(got)} rows'} {t1 - t0:.1f}s{note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
