"""Modes of columns with very many values (G9, C9) without a shuffle of every value.

Each task keeps a Misra-Gries summary of ``counters`` values per column.  A value's
count in its summary is at most the summary's error too low, so with the errors added
up a value that the merged summaries put more than that sum behind the best cannot be a
mode.  The values that remain are counted exactly in a second pass, which joins rows to
them by broadcast.  Where the summaries cannot decide (no value stands out, or more than
``candidates`` remain) every value is counted, as ``profile.modes`` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.operators import profile
from quakes.sources.table import materialize

COUNTERS = 1000
CANDIDATES = 10_000


def _summaries(cols: list[str], counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {c: (np.empty(0), np.empty(0, np.int64)) for c in cols}
        error = dict.fromkeys(cols, 0)
        for b in batches:
            for i, c in enumerate(cols):
                values = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                both = np.concatenate([kept[c][0], values + 0.0])  # one zero
                weight = np.concatenate([kept[c][1], np.ones(len(values), np.int64)])
                found, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weights=weight, minlength=len(found)).astype(np.int64)
                if len(found) > counters:
                    # what the first value beyond the counters has is taken from all
                    less = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
                    error[c] += less
                    stays = counts > less
                    found, counts = found[stays], counts[stays] - less
                kept[c] = found, counts
        for c in cols:  # a null value carries the error
            value = pa.array([*kept[c][0].tolist(), None], pa.float64(), from_pandas=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(value), pa.string()), value, pa.array([*kept[c][1].tolist(), error[c]], pa.int64())],
                names=["col_name", "value", "low"],
            )

    return run


def summaries(df: DataFrame, cols: list[str], counters: int = COUNTERS) -> DataFrame:
    """Merged summaries: ``col_name, value, low``; the row of the null value has the sum of
    the errors.  At most tasks x columns x (counters + 1) rows are shuffled."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    each = wide.mapInArrow(_summaries(cols, counters), "col_name string, value double, low long")
    return each.groupBy("col_name", "value").agg(F.sum("low").alias("low"))


def frequent_modes(
    df: DataFrame, cols: list[str] = profile.PROFILE_COLUMNS, counters: int = COUNTERS, candidates: int = CANDIDATES
) -> DataFrame:
    """``col_name, value, count`` as ``profile.modes`` gives them: every most frequent value
    (ties all kept), nulls skipped; a column of nulls alone has no row."""
    merged = materialize(summaries(df, cols, counters), uuid.uuid4().hex, "summaries")
    best = merged.groupBy("col_name").agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("low"))).alias("best"),
        F.max(F.when(F.col("value").isNull(), F.col("low"))).alias("error"),
    )
    # a value in no summary may have as many rows as the errors allow
    sure = (F.col("best") > F.col("error")) & (F.col("low") + F.col("error") >= F.col("best"))
    left = merged.where("value IS NOT NULL").join(F.broadcast(best), "col_name").where(sure)  # a row per column
    found = [(r["col_name"], r["value"]) for r in left.limit(candidates + 1).collect()]
    has_values = [r["col_name"] for r in best.where("best > 0 OR error > 0").collect()]  # a row per column
    quick = {c for c, _ in found} if len(found) <= candidates else set()
    slow = [c for c in has_values if c not in quick]
    out = profile.modes(df, slow or cols) if slow or not quick else None
    if quick:
        keep = df.sparkSession.createDataFrame(found, "col_name string, value double")  # at most ``candidates`` rows
        rows = profile.long_values(df, sorted(quick)).join(F.broadcast(keep), ["col_name", "value"])
        exact = profile.top_counts(rows.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("count")))
        out = exact if out is None else out.unionByName(exact)
    return out
