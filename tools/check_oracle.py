"""Run registered queries next to their SQL twins and report differences.

usage: python tools/check_oracle.py [--sf sf0.01] [prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pandas.api.types import is_extension_array_dtype  # noqa: E402

from boardlake.plans import load  # noqa: E402
from boardlake.plans.catalog import QUERIES  # noqa: E402
from boardlake.plans.views import TABLES  # noqa: E402
from boardlake.session import local_session  # noqa: E402


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


def plain(pdf):
    """Whole numbers with nulls come from Spark as floats and from newer DuckDB as nullable integers: floats for both."""
    nullable = [c for c in pdf.columns if is_extension_array_dtype(pdf[c].dtype) and pdf[c].dtype.kind in "iu" and pdf[c].isna().any()]
    return pdf.astype({c: "float64" for c in nullable})


def compare(left, right):
    left, right = plain(left), plain(right)
    lc, lr = rows_of(left)
    rc, rr = rows_of(right)
    if lc != rc:
        return f"columns differ: {lc} vs {rc}"
    kinds = [(c, left[c].dtype.kind, right[c].dtype.kind) for c in lc if left[c].dtype.kind != right[c].dtype.kind]
    if kinds:
        return f"types differ: {kinds}"
    if len(lr) != len(rr):
        return f"row counts differ: {len(lr)} vs {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first: {bad[0]} (columns {lc})"
    return None


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/{args.sf}"
    load()
    spark = local_session("check")
    con = duck(folder)
    failed = []
    for name, q in sorted(QUERIES.items()):
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        try:
            t0 = time.time()
            got = q.run(spark, folder).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"rows {name} n={len(got)} {t1 - t0:.2f}s", flush=True)
                continue
            want = con.execute(q.sql).df()
            problem = compare(got, want)
            exact = [
                (c, str(got[c].dtype), str(want[c].dtype)) for c in sorted(got.columns)
                if c in want.columns and str(got[c].dtype) != str(want[c].dtype)
            ]
            if exact:
                print(f"note {name} {exact}")
            note = f"n={len(got)} spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s"
            if problem:
                failed.append(name)
                print(f"BAD  {name} {note} {problem[:700]}", flush=True)
            else:
                print(f"ok   {name} {note}" + ("  EMPTY" if len(got) == 0 else ""), flush=True)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            text = str(error).split("JVM stacktrace")[0][:900]
            print(f"ERR  {name} {type(error).__name__}: {text}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
