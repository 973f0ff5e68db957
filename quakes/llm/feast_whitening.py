"""Whitening of embeddings with components found by FEAST contour integration.

Vectors become whole numbers (``floor(scale * entry)``), so sums and the covariance
of the distinct vectors are exact whatever the partitioning: tasks centre the vectors
on the rounded mean before they multiply, and add up whole numbers.

The components are eigenvectors of the d x d covariance.  Inertia counts (signs of the
pivots of a symmetric factorisation) tell how many eigenvalues lie above a shift, which
finds an interval with those wanted and splits it.  For each interval FEAST integrates
the resolvent along a circle around it: solves with complex shifts at Gauss-Legendre
nodes project a block of vectors onto the interval's eigenspace, Rayleigh-Ritz extracts
the pairs, and this is repeated until residuals are at rounding level.  The number of
pairs must equal the inertia count, so none is missed.

The driver holds the sums and the covariance (d and d*d numbers, whatever the number of
vectors) and solves there; vectors stay in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import store, table

SCALE = 256
EXACT = 1 << 53  # whole numbers below it are exact doubles
BLOCK = 4096  # vectors multiplied at a time
PIVOT = (1 + 17**0.5) / 8
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenpairs of a symmetric matrix -------------------------------------------


def inertia_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` greater than ``shift``: positive pivots of a factorisation
    of ``a - shift`` with complete pivoting (Bunch and Parlett); a pivot of two rows
    has one eigenvalue of each sign."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        n = len(m)
        diagonal = np.abs(np.diagonal(m))
        k = int(diagonal.argmax())
        off = np.abs(m)
        np.fill_diagonal(off, 0)
        r, s = divmod(int(off.argmax()), n)
        if not diagonal[k] and not off[r, s]:
            break  # all that is left is zero
        if diagonal[k] >= PIVOT * off[r, s]:
            above += int(m[k, k] > 0)
            gone, rest = [k], np.delete(np.arange(n), k)
        else:
            above += 1
            gone, rest = [r, s], np.delete(np.arange(n), [r, s])
        c = m[np.ix_(rest, gone)]
        m = m[np.ix_(rest, rest)] - c @ np.linalg.solve(m[np.ix_(gone, gone)], c.T)
        m = (m + m.T) / 2
    return above


def _contour(a: np.ndarray, block: np.ndarray, lo: float, hi: float, nodes: int) -> np.ndarray:
    """The block's part in the eigenspace of (lo, hi): quadrature over the upper half circle."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    out, eye = np.zeros_like(block), np.eye(len(a))
    for angle, weight in zip(np.pi * (x + 1) / 2, w, strict=True):
        turn = (hi - lo) / 2 * np.exp(1j * angle)
        out += weight / 2 * (turn * np.linalg.solve(((lo + hi) / 2 + turn) * eye - a, block)).real
    return out


def feast(a: np.ndarray, lo: float, hi: float, count: int, nodes: int = 12, rounds: int = 40, seed: int = 5):
    """The ``count`` eigenpairs with values in (lo, hi]; ``None`` if they are not found."""
    d = len(a)
    size = np.linalg.norm(a)
    block = np.random.default_rng(seed).normal(size=(d, min(d, count + max(4, count // 2))))
    best, found = np.inf, None
    for _ in range(rounds):
        q, _ = np.linalg.qr(_contour(a, block, lo, hi, nodes))
        small = q.T @ a @ q
        values, turn = np.linalg.eigh((small + small.T) / 2)
        block = q @ turn
        inside = (values > lo) & (values <= hi)
        if inside.sum() != count:
            continue
        v, x = values[inside], block[:, inside]
        residual = np.abs(a @ x - x * v).max()
        if residual < best:
            found = v, x
        if residual <= 4 * np.finfo(float).eps * size or (residual >= best / 2 and best <= 1e-12 * size):
            return found  # at rounding level, or no longer falling there
        best = min(best, residual)
    return found if best <= 1e-11 * size else None


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals ``(lo, hi, eigenvalues in it)`` from the top that hold the ``wanted``
    largest eigenvalues (and those equal to the last), zero ones left out."""
    top = float(np.abs(a).sum(axis=1).max())
    floor = top * len(a) * np.finfo(float).eps
    if not top or not (wanted := min(wanted, inertia_above(a, floor))):
        return []
    top *= 1 + 1e-9
    low, high = floor, top  # at least ``wanted`` above low, fewer above high
    count = inertia_above(a, low)
    while count > wanted and high - low > 1e-10 * high:
        middle = (low * high) ** 0.5
        above = inertia_above(a, middle)
        low, high, count = (middle, high, above) if above >= wanted else (low, middle, count)
    out, hi, seen = [], top, 0
    while seen < count:
        lo = max(low, hi / 8) if hi / 8 > 2 * low else low
        above = count if lo == low else inertia_above(a, lo)
        if above > seen:
            out.append((lo, hi, above - seen))
        hi, seen = lo, above
    return out


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding level, falling, and their unit
    eigenvectors as columns."""
    parts = intervals(a, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(a), 0))
    count = sum(n for _, _, n in parts)
    pairs = [feast(a, *p) for p in parts]
    if any(p is None for p in pairs):  # an eigenvalue on a border between intervals
        pairs = [feast(a, parts[-1][0], parts[0][1], count, nodes=24, rounds=100)]
    if any(p is None for p in pairs):
        raise ArithmeticError(f"inertia counts {count} eigenvalues, the contour did not give as many")
    q, _ = np.linalg.qr(np.concatenate([x for _, x in pairs], axis=1))
    small = q.T @ a @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values, kind="stable")[:wanted]
    return values[best], (q @ turn)[:, best]


# --- exact sums in tasks ---------------------------------------------------------


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _matrix(b.column(0).slice(at, BLOCK), d)  # below 2**53 each, so a block's sum fits
                n += len(x)
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, d), pa.int32()), "v": [str(v) for v in (n, *total)]})

    return run


def _products(d: int, centre: list[int]):
    """Sums of products of centred vectors, upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(d)
        total = np.zeros((d, d), object)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                z = _matrix(b.column(0).slice(at, BLOCK), d) - np.array(centre, np.int64)
                if len(z) * int(np.abs(z).max(initial=0)) ** 2 < EXACT:
                    z = z.astype(float)  # every partial sum is a whole number below 2**53
                    total += (z.T @ z).astype(np.int64)
                else:
                    z = z.astype(object)
                    total += z.T @ z
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "v": [str(int(v)) for v in total[upper]]}
        )

    return run


def _whiten(x: np.ndarray, mean: np.ndarray, vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (x - mean) @ vectors / np.sqrt(values)


def _moments(d: int, mean, vectors, values):
    """Number, mean and centred products of the whitened vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        state = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                w = _whiten(_matrix(b.column(0).slice(at, BLOCK), d), mean, vectors, values)
                own = w.mean(axis=0)
                state = _joined(state, (len(w), own, (w - own).T @ (w - own)))
        n, own, products = state
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [own.tolist()], "products": [products.ravel().tolist()]})

    return run


def _joined(a, b):
    """Number, mean and centred products of two parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _project(d: int, n: int, sums: list[int], mean, vectors, values):
    total = np.array([s & (1 << 64) - 1 for s in sums], np.uint64).view(np.int64)  # arithmetic modulo 2**64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _matrix(part.column(1), d)
                size = (((x.astype(float) - mean) * n) ** 2).sum(axis=1)
                if (size >= 2.0**63 * (1 - 1e-9)).any():
                    raise OverflowError("a deviation does not fit into 64 bits")
                y = x * np.int64(n) - total  # exact modulo 2**64, and so is the sum of squares, which fits
                deviation = (y * y).sum(axis=1)
                whitened = _whiten(x, mean, vectors, values)
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column(0).take(pa.array(rows)),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        "deviation": pa.array(deviation[rows]),
                        "whitened": pa.array(whitened.ravel()),
                    }
                )

    return run


# --- the operator ------------------------------------------------------------------


def whole_vector(entries: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers; one of 2**53 or more stops the query."""

    def one(c: Column) -> Column:
        v = F.floor(F.lit(scale) * c.cast("double"))
        return F.when(F.abs(F.lit(scale) * c.cast("double")) < EXACT, v).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))

    return F.transform(entries, one)


def finite(entries: Column) -> Column:
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return entries.isNotNull() & ~bad


class Whitening:
    """``n``, ``sums`` and ``mean`` of the fit list, eigenvalues and unit vectors,
    ``trace`` of the covariance and ``identity_error`` of the whitened fit list."""

    def __init__(self, n, sums, values, vectors, trace):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.mean = np.array([s / n for s in sums])
        self.identity_error = 0.0


def _decimal_sum() -> Column:
    return F.sum(F.col("v").cast("decimal(38,0)")).alias("v")


def fit(vectors: DataFrame, d: int, wanted: int = 4) -> Whitening | None:
    """From distinct vectors ``x`` of ``d`` whole numbers, stored; ``None`` without any."""
    got = {r["i"]: int(r["v"]) for r in vectors.mapInArrow(_sums(d), "i int, v string").groupBy("i").agg(_decimal_sum()).collect()}
    n, sums = got.get(-1, 0), [got.get(i, 0) for i in range(d)]
    if not n or not d:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = vectors.mapInArrow(_products(d, centre), "i int, j int, v string").groupBy("i", "j").agg(_decimal_sum())
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    a = np.zeros((d, d))
    for i, j, v in products.collect():  # d * (d + 1) / 2 rows
        a[i, j] = a[j, i] = (n * int(v) - rest[i] * rest[j]) / (n * n)  # of whole numbers, rounded once
    values, axes = components(a, wanted)
    w = Whitening(n, sums, values, axes, float(np.trace(a)))
    if len(values):
        parts = vectors.mapInArrow(_moments(d, w.mean, axes, values), "n long, mean array<double>, products array<double>")
        k, state = len(values), (0, np.zeros(len(values)), np.zeros((len(values), len(values))))
        for r in parts.where("n > 0").collect():  # a row per task
            state = _joined(state, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
        w.identity_error = float(np.abs(state[2] / state[0] - np.eye(k)).max())
    return w


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 4, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every
    row with a finite vector and each component.

    Rows whose vector is null or holds a null or non-finite entry are left out; ids may
    be null; rows that repeat are each returned but fitted once.  Vectors shorter than
    the longest count as ending in zeros.  There are fewer components than ``wanted``
    where the vectors span fewer dimensions, and none (an empty result) for a single
    distinct vector, for empty vectors or an empty table.  Other columns are not read.
    """
    spark = embeddings.sparkSession
    entries = F.col(vector_col)
    rows = embeddings.where(finite(entries)).select(F.col(id_col).cast("long").alias("vec_id"), whole_vector(entries, scale).alias("x"))
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))
    rows = rows.select("vec_id", F.when(F.size("x") == d, F.col("x")).otherwise(F.concat("x", missing)).alias("x"))
    w = fit(store(rows.select("x").distinct(), "vectors"), d, wanted) if d else None
    if w is None or not len(w.values):
        return spark.createDataFrame([], RESULT)
    out = rows.mapInArrow(
        _project(d, w.n, w.sums, w.mean, w.vectors, w.values), "vec_id long, component int, deviation long, whitened double"
    )
    share = F.element_at(F.array(*(F.lit(float(e / w.trace)) for e in w.values)), F.col("component"))
    return out.select(
        "vec_id",
        "component",
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(w.identity_error).alias("identity_error"),
    )


def op12_feast_whitening(spark, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, four components."""
    return whiten(table(spark, sf_dir, "embeddings"))
