"""Command line: list the registered queries or run one.

    python -m stewardlake list
    python -m stewardlake run access_state --sf-dir /root/testdata/sf0.01 [--out PATH] [--show 20] [--master local[8]]

``run`` writes the result as parquet to ``--out`` (shared storage on a
cluster) or prints the first ``--show`` rows; ``--sql`` prints the oracle SQL.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    parser = argparse.ArgumentParser(prog="stewardlake")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("key")
    run.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--master")
    run.add_argument("--sql", action="store_true", help="print the oracle SQL instead of running")
    args = parser.parse_args(argv)

    from stewardlake.plans.registry import oracle_sql, queries

    qs = queries()
    if args.cmd == "list":
        for k in sorted(qs):
            print(k)
        return 0
    if args.key not in qs:
        print(f"unknown query {args.key}; see `python -m stewardlake list`", file=sys.stderr)
        return 2
    if args.sql:
        print(oracle_sql().get(args.key, "-- no oracle"))
        return 0
    from pyspark.sql import SparkSession

    from stewardlake.session import build_session

    spark = SparkSession.getActiveSession() or build_session(args.master or "local[*]")
    df = qs[args.key](spark, args.sf_dir)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
