"""Contour-integrated components against numpy's solver, and the query against plain sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakes.llm import feast_whitening as fw

SF = "/root/testdata/sf0.001"


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


CASES = {
    "spread": np.linspace(1, 50, 30),
    "falling": 10.0 ** -np.arange(12),
    "pairs": np.repeat([9.0, 4.0, 1.0], 6),
    "all equal": np.full(9, 3.0),
    "one": np.array([2.5]),
    "two": np.array([7.0, 7.0]),
    "low rank": np.concatenate([[5.0, 3.0], np.zeros(14)]),
    "close": np.array([1, 1 + 1e-9, 1 + 2e-9, 1 + 3e-9, 1 - 1e-9, 0.5, 0.1]),
    "border": np.array([64.0, 8.0, 8.0, 1.0, 1.0, 1.0, 0.125]),
    "far apart": np.array([1e12, 5.0, 4.0, 3.0, 2.0, 1.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_components(name):
    values = CASES[name]
    a = spectrum(values)
    got, x = fw.components(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    rank = int((values > 1e-13 * values.max()).sum())
    assert len(got) == min(4, rank)
    scale = values.max()
    assert np.allclose(got, want[: len(got)], rtol=0, atol=1e-13 * scale * len(a))
    assert np.abs(a @ x - x * got).max() <= 2e-13 * scale * len(a)
    assert np.allclose(x.T @ x, np.eye(len(got)), atol=1e-12)


@pytest.mark.parametrize("seed", range(5))
def test_inertia(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(25, 25))
    a = a + a.T
    np.fill_diagonal(a, 0)  # needs pivots of two rows
    values = np.linalg.eigvalsh(a)
    for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
        assert fw.inertia_above(a, shift) == int((values > shift).sum())


def test_zero_matrix_has_no_components():
    assert fw.components(np.zeros((5, 5)), 4)[0].size == 0


def plain(rows, wanted=4):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in ok), default=0)
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (d - len(v))) for i, v in ok]
    fit = sorted({v for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    out = {}
    for i, v in x:
        y = [n * c - t for c, t in zip(v, s, strict=True)]
        out[i] = (n, sum(c * c for c in y), np.array(y) / n @ axes / np.sqrt(values), values / np.trace(cov))
    return out


def check(got, want):
    rows = {}
    for r in got.collect():
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    assert rows.keys() == want.keys()
    k = len(next(iter(want.values()))[2])
    sign = [0.0] * k
    for i, parts in rows.items():
        n, deviation, white, share = want[i]
        assert sorted(parts) == list(range(1, k + 1))
        for c, r in parts.items():
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            assert abs(r["explained"] / share[c - 1] - 1) < 1e-9
            if abs(white[c - 1]) > 1e-6:
                sign[c - 1] = sign[c - 1] or math.copysign(1, r["whitened"] * white[c - 1])
            assert abs(r["whitened"] - sign[c - 1] * white[c - 1]) < 1e-8


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(fw.op12_feast_whitening(spark, SF), plain(rows))


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in np.float32(rng.normal(size=6) * [9, 5, 3, 1, 0.5, 0.1])]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(200)]  # one vector many times
    rows += [(400, None), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []), (405, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    df = df.withColumns({c: F.lit(1) for c in ("x", "i", "v", "n", "component")})
    check(fw.whiten(df), plain(rows))


def test_large_numbers_stay_exact(spark):
    big = [(1, [1e9, 0.0]), (2, [1e9 + 64, 1.0]), (3, [1e9 - 64, 5.0]), (4, [1e9 + 128, -3.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in fw.whiten(df).collect()}
    x = np.array([[math.floor(256 * c) for c in v] for _, v in big], object)
    dev = ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [got[k, 1]["deviation"] for k in (1, 2, 3, 4)] == dev.tolist()
    assert got[1, 1]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = fw.whiten(df)
    assert got.count() == 0 and got.columns[0] == "vec_id"
