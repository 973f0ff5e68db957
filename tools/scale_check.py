"""Scaling check: the driver's ``events`` table copied k times (ids shifted so
every copy is a distinct event), landed once under the session's checkpoint
folder, then the ETL and a few questions are timed on it.

    python tools/scale_check.py 10 [/root/testdata/sf0.1]

Prints one JSON line.  Not part of the registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(k: int, sf_dir: str) -> None:
    from pyspark.sql import functions as F

    from quakes.plans import catalog
    from quakes.plans.pipeline import build_eq
    from quakes.session import build_session, table_dir
    from quakes.sources.fixture import quake_view
    from quakes.sources.table import save_table

    spark = build_session(app="quakes-scale")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = ev.agg(F.max("event_id") - F.min("event_id") + 1).first()[0]
    # k copies of every event (a generator column, shifted ids)
    big = ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy")).select(
        (F.col("event_id") + F.col("copy") * span).alias("event_id"), "ts", "user_id", "event_type", "value", "props"
    )
    landed = table_dir(spark, sf_dir, f"events-x{k}")
    big.write.mode("overwrite").parquet(landed)

    # warm-up on the original size
    save_table(build_eq(quake_view(ev), "scale-warm"), table_dir(spark, "scale-warm", "eq"))

    t = time.perf_counter()
    eq = save_table(build_eq(quake_view(spark.read.parquet(landed)), landed), table_dir(spark, landed, "eq"))
    out = {"copies": k, "rows": eq.count(), "etl": round(time.perf_counter() - t, 2)}
    for key in ("q1", "q12", "q16", "q22", "q29"):
        fn = catalog.BY_KEY[key].fn
        fn(eq).count()
        t = time.perf_counter()
        fn(eq).count()
        out[key] = round(time.perf_counter() - t, 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 10, sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1")
