"""A3: consecutive events (global time order) close in time and space.

"Consecutive" means neighbours in the global order (time, id).  A global
window would pull the table into one task, and hour buckets put a swarm hour
(or any hot hour) into one task, so instead:

1. ``repartitionByRange(time, id)``: sampled range bounds split the order
   into balanced slices, also when one hour or one timestamp holds a third
   of all rows (the id breaks ties, so equal times can still be split).
2. Inside each slice, sorted, the previous row is the previous event.  That
   is a per-partition scan, done on Arrow batches with ``mapInArrow`` (no
   second shuffle, no per-row Python).  It emits candidate pairs within the time limit plus the
   first and last row of the slice.
3. The slice edges (two rows per partition) are ordered and paired with
   ``lag``; that table is bounded by the partition count.
4. Distance (haversine) and the limits are JVM expressions.

The candidate output is checkpointed to the shared checkpoint folder, so the
Python pass runs once and the job survives executor loss.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakes.functions.geo import haversine_km
from quakes.functions.timeparts import epoch_micros
from quakes.session import checkpoint_dir

ROWS_PER_SLICE = 4_000_000  # of four narrow columns

# The slice scan travels whole: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Row kinds emitted by the slice scan.
PAIR, FIRST, LAST = 0, 1, 2

_OUT = (
    "kind tinyint, prev_id string, prev_t long, prev_lat double, prev_lon double, "
    "id string, t long, lat double, lon double"
)
_COLS = ["kind", "prev_id", "prev_t", "prev_lat", "prev_lon", "id", "t", "lat", "lon"]
_ARROW = pa.schema(
    [
        ("kind", pa.int8()),
        ("prev_id", pa.string()),
        ("prev_t", pa.int64()),
        ("prev_lat", pa.float64()),
        ("prev_lon", pa.float64()),
        ("id", pa.string()),
        ("t", pa.int64()),
        ("lat", pa.float64()),
        ("lon", pa.float64()),
    ]
)
_FIELDS = ["id", "t", "lat", "lon"]


def _cols(b: pa.RecordBatch) -> list[pa.Array]:
    return [b.column(b.schema.get_field_index(c)) for c in _FIELDS]


def _batch(kind: int, prev: list[pa.Array] | None, cur: list[pa.Array]) -> pa.RecordBatch:
    n = len(cur[0])
    if prev is None:
        prev = [pa.nulls(n, f.type) for f in _ARROW][1:5]
    arrays = [pa.array(np.full(n, kind, dtype=np.int8))] + list(prev) + list(cur)
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _ARROW)], schema=_ARROW)


def _slice_neighbours(max_gap_us: int):
    """Per sorted slice: (previous, current) pairs within ``max_gap_us``, plus
    the slice's first and last row.  Works on Arrow arrays (no per-row Python)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.Array] | None = None  # last row of the previous batch
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            cur = _cols(b)
            if carry is None:
                yield _batch(FIRST, None, [a.slice(0, 1) for a in cur])
                prev = [a.slice(0, n - 1) for a in cur]
                cur = [a.slice(1) for a in cur]
            else:
                prev = [pa.concat_arrays([c, a.slice(0, n - 1)]) for c, a in zip(carry, cur)]
            carry = [a.slice(n - 1, 1) for a in _cols(b)]
            if len(cur[0]) == 0:
                continue
            keep = pc.less_equal(pc.subtract(cur[1], prev[1]), max_gap_us)
            if pc.any(keep).as_py():
                yield _batch(PAIR, [pc.filter(a, keep) for a in prev], [pc.filter(a, keep) for a in cur])
        if carry is not None:
            yield _batch(LAST, None, carry)

    return run


def _finish(pairs: DataFrame, max_km: float, max_seconds: float) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    dist = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    gap_s = (F.col("t") - F.col("prev_t")) / F.lit(1_000_000.0)
    return (
        pairs.select(
            F.col("prev_id"),
            F.col("id"),
            F.timestamp_add("MICROSECOND", F.col("prev_t"), epoch).alias("prev_time"),
            F.timestamp_add("MICROSECOND", F.col("t"), epoch).alias("time"),
            gap_s.alias("gap_s"),
            dist.alias("distance_km"),
        )
        .where((F.col("gap_s") <= max_seconds) & (F.col("distance_km") <= max_km))
    )


def slices_needed(ev: DataFrame, rows_per_slice: int) -> int | None:
    """A slice count that grows with the rows, or None where the session's partitions do."""
    needed = -(-ev.count() // rows_per_slice)
    return needed if needed > int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def slice_candidates(
    df: DataFrame, max_km: float, max_seconds: float, slices: int | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Range slices of (time, id), scanned in order: candidate pairs inside
    each slice (within both limits) and every slice's first and last row."""
    ev = df.where(F.col("time").isNotNull()).select(
        F.col("id"),
        epoch_micros(F.col("time")).alias("t"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
    )
    slices = slices or slices_needed(ev, rows_per_slice)
    # Without a fixed count AQE sizes the slices (coalescing keeps adjacent
    # ranges together, so every slice is still one contiguous range).
    ranged = ev.repartitionByRange(slices, "t", "id") if slices else ev.repartitionByRange("t", "id")
    ordered = ranged.sortWithinPartitions("t", "id")
    cand = ordered.mapInArrow(_slice_neighbours(int(max_seconds * 1_000_000)), _OUT)
    dist = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return cand.where((F.col("kind") != PAIR) | (dist <= max_km))


def consecutive_pairs(
    df: DataFrame,
    max_km: float = 50.0,
    max_seconds: float = 3600.0,
    slices: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """prev_id, id, prev_time, time, gap_s, distance_km for consecutive events
    at most ``max_seconds`` apart and at most ``max_km`` apart.  A slice has about
    ``rows_per_slice`` rows at most, however many partitions the session shuffles to."""
    checkpoint_dir(df.sparkSession)
    cand = slice_candidates(df, max_km, max_seconds, slices, rows_per_slice).checkpoint(eager=True)

    inner = cand.where(F.col("kind") == PAIR)
    edges = cand.where(F.col("kind") != PAIR)
    # Bounded by 2 x partitions: ordering it in one task is cheap.  A slice's
    # FIRST row sorts before its LAST row when both are the same event.
    w = Window.orderBy("t", "id", "kind")
    edge_pairs = (
        edges.select(
            "kind",
            *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("id", "t", "lat", "lon")],
            "id",
            "t",
            "lat",
            "lon",
        )
        .where((F.col("kind") == FIRST) & F.col("prev_t").isNotNull())
    )
    return _finish(inner.unionByName(edge_pairs.select(*_COLS)), max_km, max_seconds)


def consecutive_pairs_bruteforce(df: DataFrame, max_km: float = 50.0, max_seconds: float = 3600.0) -> DataFrame:
    """Reference implementation with one global window (small data / tests only)."""
    w = Window.orderBy("t", "id")
    ev = df.where(F.col("time").isNotNull()).select(
        "id", epoch_micros(F.col("time")).alias("t"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )
    pairs = ev.select(
        *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("id", "t", "lat", "lon")], "id", "t", "lat", "lon"
    ).where(F.col("prev_t").isNotNull())
    return _finish(pairs, max_km, max_seconds)
