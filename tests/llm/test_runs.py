"""Periodic runs against a plain search over all periods and starts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakes.llm import periodic_runs

from . import brute

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every maximal stretch with smallest period q and max(6, 4q) words."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and w[e] == w[e - q]:
                e += 1
            if e - s >= max(6, 4 * q) and not any(
                q % d == 0 and all(w[k] == w[k - d] for k in range(s + d, e)) for d in range(1, q)
            ):
                out.append((s, e - s, q))
            s = e - q + 1
    return sorted(out)


def plain(doc_id, text, plant=True):
    w = brute.words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    keep = [not any(s + q <= i < s + k for s, k, q in runs) for i in range(n)]
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)),
    )


def caught(words, step):
    c = periodic_runs.SquareCatcher()
    for at in range(0, len(words), step):
        c.append(np.array(words[at : at + step], np.int64))
    return c.runs()


@settings(max_examples=250, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8), st.integers(1, 70))
def test_catcher_equals_plain_however_words_arrive(parts, step):
    words = [x for part, times in parts for x in part * times]
    assert caught(words, step) == plain_runs(words)


@pytest.mark.parametrize("seed", range(6))
def test_two_letter_streams_word_by_word(seed):
    rng = random.Random(seed)
    words = [rng.choice([0, 0, 0, 1]) for _ in range(600)]
    at = rng.randrange(300)
    words[at : at + 200] = (words[at : at + 37] * 6)[:200]
    assert caught(words, 1) == caught(words, 7) == caught(words, 10**6) == plain_runs(words)


def test_nested_powers():
    words = [0]
    for k in range(1, 5):
        words = words * 4 + [k]
    words = words * 5
    assert caught(words, 13) == plain_runs(words)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (6, "a b a b a b a b c"), (6, "a b a b a b a b c"),
    (None, "x x x x x x x"), (None, None), (7, "A a A a A a a A a"), (8, "é\x0bé\x0cé\té\ré\né\x85 é"), (9, "one two three " * 500),
    (10, "w " * 50_000), (11, " ".join(str(k % 7919) for k in range(40_000))), (12, "a b c " * 4 + "a b d " * 4),
]


def test_documents(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in real if len(brute.words(t)) <= 400] + [r for r in AWKWARD if r[0] not in (10, 11)]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(3).withColumn("runs", F.lit(1)).withColumn("start", F.lit(2))
    got = [tuple(r) for r in periodic_runs.run_digests(df, plant=True).collect()]
    assert sorted(got, key=repr) == sorted((plain(i, t) for i, t in short), key=repr)
    assert any(g[1] for g in got)
    rows = periodic_runs.find_runs(df).collect()
    want = sorted(repr((i, plain_runs(brute.words(t)))) for i, t in short)
    assert sorted(repr((r["doc_id"], list(zip(r["starts"], r["lengths"], r["periods"], strict=True)))) for r in rows) == want


def test_long_texts_in_pieces(spark, monkeypatch):
    long = [r for r in AWKWARD if r[0] in (10, 11)]
    got = {i: r for i, _, r in _caught(long)}
    assert got[10] == [(0, 50_000, 1)] and got[11] == [(0, 40_000, 7919)]
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 50)
    monkeypatch.setattr(periodic_runs, "APPEND_WORDS", 1000)
    assert {i: r for i, _, r in _caught(long)} == got


def _caught(rows):
    s = periodic_runs._Stream(False)
    for r in rows:
        s.add(*r)
    return s.catch()


def test_empty(spark):
    assert periodic_runs.run_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = periodic_runs.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        if len(brute.words(t)) <= 1500:
            assert rows[i] == plain(i, t)
