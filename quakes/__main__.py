"""Command line: build the EQ table from landed feed pages, list the named
questions, run one by key or label (numbered rows, R1 + R2).

    python -m quakes list
    python -m quakes build LANDING_DIR TABLE_DIR [--features]
    python -m quakes query TABLE_DIR KEY_OR_LABEL [--rows N] [--sql]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quakes")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the named questions")
    b = sub.add_parser("build", help="landed feed pages -> stored EQ table")
    b.add_argument("landing")
    b.add_argument("table")
    b.add_argument("--start", help="first day of the load, YYYY-MM-DD (with --end; default: all)")
    b.add_argument("--end", help="day after its last")
    b.add_argument("--min-mag", type=float, help="least magnitude of the load (default: all)")
    b.add_argument("--quarantine", help="folder for pages and features that cannot be parsed (default: stop)")
    b.add_argument("--features", action="store_true", help="one GeoJSON feature per line instead of page documents")
    q = sub.add_parser("query", help="run one named question on a stored EQ table")
    q.add_argument("table")
    q.add_argument("question")
    q.add_argument("--rows", type=int, default=50, help="rows to print")
    q.add_argument("--sql", action="store_true", help="run the SQL text form")
    args = ap.parse_args(argv)

    from quakes.plans import catalog

    if args.cmd == "list":
        for nq in catalog.CATALOG:
            print(f"{nq.key:6s} {nq.label}")
        return 0

    from quakes.operators.serial import serial_numbers
    from quakes.schema import EQ
    from quakes.session import build_session

    spark = build_session()
    if args.cmd == "build":
        from quakes.plans.pipeline import build_eq
        from quakes.sources import feed, pages
        from quakes.sources.table import materialize, save_table_counted

        if args.features and args.quarantine:
            ap.error("--quarantine is for page documents")
        feats = feed.read_features(spark, args.landing) if args.features else pages.read_pages(spark, args.landing, args.quarantine)
        raw = feed.flatten(feats)
        if args.start or args.end or args.min_mag is not None:
            raw = feed.source_filter(raw, args.start or "0001-01-01", args.end or "9999-12-31", -99.0 if args.min_mag is None else args.min_mag)
        # stored once: medians, lookup and table each read it
        _, n = save_table_counted(build_eq(materialize(raw, args.landing, "raw"), args.landing), args.table)
        print(f"loaded {n} rows into {args.table}")
        return 0

    eq = spark.read.schema(EQ).parquet(args.table)
    nq = catalog.BY_KEY.get(args.question) or catalog.BY_LABEL.get(args.question)
    if nq is None:
        print(f"unknown question: {args.question}", file=sys.stderr)
        return 2
    if args.sql:
        from quakes.plans.sql import run_sql

        result = run_sql(spark, eq, nq.key)
    else:
        result = nq.fn(eq)
    print(nq.label)
    # R2: number rows in result order; results of any size in slices
    number = catalog.numbered if nq.bounded else serial_numbers
    result = number(result.withColumn("_pos", F.monotonically_increasing_id()), "_pos").drop("_pos")
    if not nq.bounded:
        result = result.orderBy("S_No")
    result.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
