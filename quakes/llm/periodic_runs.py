"""Periodic runs of words by online dyadic square catching.

A catcher is kept for every completed block of ``b = 2**k`` words.  Each appended
word ends a suffix of ``b`` words, and at each level that suffix lies a distance of
``b`` to ``2b - 1`` behind exactly one block: the two are compared by their hashes
(of two half-size hashes, so a level costs one step per word).  Two neighbouring
blocks that both meet their copies at one distance p are a square of period p.  A
square is checked and extended word by word into its maximal repetition, and later
squares inside it are passed over, so squares merge into runs.

A run of period q and length 4q or more holds two neighbouring blocks of the level
with ``b <= q < 2b`` and their copies, so none is missed.  A square that lies in a
repetition of a smaller period has no period of its own (Fine and Wilf) and is
dropped, so periods are smallest.

A stream holds the words of several documents with separators that occur once.
State: the word numbers of the stream, and O(b) hashes of each level.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import table

EXPONENT, LEAST = 4, 6  # a run has max(LEAST, EXPONENT * period) words or more
STREAM_WORDS = 1 << 16  # documents are gathered into streams of about so many words
APPEND_WORDS = 1 << 18  # appended at a time, which bounds the arrays of a level
SLICE_BYTES = 1 << 20  # a long text is split into words piece by piece
SPACES = re.compile(rb"[ \t\n\x0b\x0c\r]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


class _Level:
    """Hashes of suffixes of ``b`` words by first word, and which of them met their block."""

    def __init__(self, b: int):
        self.b = b
        self.first = self.next = 0  # words whose hashes are kept
        self.hashes = np.zeros(0, np.uint64)
        self.met = np.zeros(b, bool)  # of the last b words before ``next``

    def extend(self, hashes: np.ndarray) -> np.ndarray:
        """Add hashes; returns first words of the suffixes that end a new square."""
        b, lo = self.b, self.next
        self.hashes = np.concatenate([self.hashes, hashes])
        self.next += len(hashes)
        at = np.arange(lo, self.next)
        block = (at // b - 1) * b - self.first
        met = self.hashes[at - self.first] == self.hashes[np.maximum(block, 0)]
        if lo < b:
            met[: b - lo] = False  # no block lies a period before these
        both = np.concatenate([self.met, met])
        self.met = both[len(both) - b :]
        return at[np.nonzero(met & both[: len(met)])[0]]

    def trim(self) -> None:
        keep = min(len(self.hashes), 4 * self.b)
        self.first = self.next - keep
        self.hashes = self.hashes[len(self.hashes) - keep :]


class SquareCatcher:
    """Runs of a stream of word numbers; ``append`` takes words one by one or many at
    a time, with the same result.  ``max_period`` bounds the levels where it is known."""

    def __init__(self, max_period: int | None = None):
        self.words, self.n = np.zeros(1024, np.int64), 0
        self.max_period = max_period
        self.levels: list[_Level] = []
        self.found: list[list[int]] = []  # start, stop, period
        self.open: list[list[int]] = []  # those that reach the end so far
        self.recent: list[list[int]] = []  # those that end in the words of the last append or reach them

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.zeros(max(self.n, 2 * len(self.words)), np.int64)
            grown[:old] = self.words[:old]
            self.words = grown
        self.words[old : self.n] = words
        for run in self.open:
            run[1] = self._right(run[1], run[2])
        self.recent = list(self.open)
        self.open = [r for r in self.open if r[1] == self.n]
        k, b = 0, 1
        while b < self.n and (self.max_period is None or b <= self.max_period):
            if k == len(self.levels):
                self.levels.append(_Level(b))
            level = self.levels[k]
            lo, hi = level.next, self.n - b + 1
            if k == 0:
                hashes = _mix(self.words[lo:hi].astype(np.uint64) + _B)
            else:
                half = self.levels[k - 1]
                left = half.hashes[lo - half.first : hi - half.first]
                right = half.hashes[lo + b // 2 - half.first : hi + b // 2 - half.first]
                hashes = _mix(left * _B + (right ^ (right >> np.uint64(17))))
            squares = level.extend(hashes)
            if len(squares):
                self._catch(squares, b)
            k, b = k + 1, 2 * b
        for level in self.levels:
            level.trim()

    def _catch(self, last: np.ndarray, b: int) -> None:
        """Squares whose second block's copy begins at ``last``."""
        first = (last // b - 2) * b  # the first of the two blocks
        period = last - b - first
        known = sorted((r[0], r[1]) for r in self.recent if r[2] < 2 * b)
        if known:
            start, stop = np.array(known).T
            stop = np.maximum.accumulate(stop)
            at = np.searchsorted(start, first, "right") - 1
            new = (at < 0) | (stop[at] < last + b)
            last, first, period = last[new], first[new], period[new]
        order = np.lexsort((first, period))
        first, period = first[order], period[order]
        k = 0
        while k < len(first):
            p, f = int(period[k]), int(first[k])
            stop = self._right(f + p, p)
            if stop < f + p + 2 * b:  # equal hashes of different words
                k += 1
                continue
            run = [self._left(f, p), stop, p]
            if stop == self.n:
                self.open.append(run)
            if stop == self.n or self.is_run(run):
                self.found.append(run)
                self.recent.append(run)
            end = np.searchsorted(period, p, "right")
            k += int(np.searchsorted(first[k:end], stop - p - 2 * b, "right"))

    def _right(self, at: int, p: int) -> int:
        """First word from ``at`` on that differs from the one p before it."""
        t, step = self.words, 8
        while at < self.n:
            to = min(at + step, self.n)
            same = t[at:to] == t[at - p : to - p]
            if not same.all():
                return at + int(same.argmin())
            at, step = to, 2 * step
        return at

    def _left(self, at: int, p: int) -> int:
        """Least word down to which all words before ``at`` equal the ones p after them."""
        t, step = self.words, 8
        while at > 0:
            to = max(at - step, 0)
            same = (t[to:at] == t[to + p : at + p])[::-1]
            if not same.all():
                return at - int(same.argmin())
            at, step = to, 2 * step
        return at

    @staticmethod
    def is_run(run: list[int]) -> bool:
        return run[1] - run[0] >= max(LEAST, EXPONENT * run[2])

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of the runs so far by start, then period."""
        return sorted((s, e - s, p) for s, e, p in filter(self.is_run, self.found))


def word_slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece at a time (a word is never cut)."""
    at = 0
    while at < len(data):
        gap = SPACES.search(data, at + SLICE_BYTES)
        to = gap.start() if gap else len(data)
        yield data[at:to].split()
        at = to


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word each word becomes; ``None``: all stay (also with a null id)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


class _Stream:
    """Documents whose words are caught in one stream."""

    def __init__(self, plant: bool):
        self.plant = plant
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        get = self.codes.__getitem__
        parts = [np.fromiter(map(get, w), np.int64, len(w)) for w in word_slices((text or "").encode())]
        words = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)
        source = planted(len(words), doc_id) if self.plant else None
        self.docs.append((doc_id, words if source is None else words[source]))
        self.size += len(words) + 1

    def catch(self) -> list[tuple[int | None, np.ndarray, list[tuple[int, int, int]]]]:
        """Each document with its runs."""
        catcher = SquareCatcher(max((len(w) for _, w in self.docs), default=0) // EXPONENT)
        starts, at = [], 0
        for k, (_, words) in enumerate(self.docs):
            starts.append(at)
            at += len(words) + 1
        stream = np.zeros(at, np.int64)
        for k, (start, (_, words)) in enumerate(zip(starts, self.docs, strict=True)):
            stream[start : start + len(words)] = words
            stream[start + len(words)] = -1 - k  # a separator that occurs once
        for lo in range(0, at, APPEND_WORDS):
            catcher.append(stream[lo : lo + APPEND_WORDS])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in self.docs]
        found = catcher.runs()
        for k, (s, length, p) in zip(np.searchsorted(starts, [r[0] for r in found], "right") - 1, found, strict=True):
            runs[k].append((s - starts[k], length, p))
        return [(doc_id, words, r) for (doc_id, words), r in zip(self.docs, runs, strict=True)]


def collapsed_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that stay: those in no run after its first period."""
    keep = np.ones(n, bool)
    for s, length, p in runs:
        keep[s + p : s + length] = False
    return keep


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "doc_id long, starts array<long>, lengths array<long>, periods array<long>"


def _digest(doc_id, words: np.ndarray, runs, vocabulary: list[bytes]) -> tuple:
    text, kept = hashlib.sha256(), words[collapsed_mask(len(words), runs)] if runs else words
    for lo in range(0, len(kept), APPEND_WORDS):
        text.update((b" " if lo else b"") + b" ".join([vocabulary[c] for c in kept[lo : lo + APPEND_WORDS].tolist()]))
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    exponent = 1000 * top[1] // top[2] if runs else None
    lines = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
    return doc_id, len(runs), *top, exponent, lines.hexdigest(), text.hexdigest()


def _run_digests(plant: bool):
    fields = [f.split() for f in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _streams(batches, plant):
            vocabulary = list(stream.codes)
            rows = [_digest(i, words, runs, vocabulary) for i, words, runs in stream.catch()]
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], names=[n for n, _ in fields]
            )

    return run


def _streams(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[_Stream]:
    stream = _Stream(plant)
    for b in batches:
        for k in range(b.num_rows):  # one text at a time in Python
            stream.add(b.column(0)[k].as_py(), b.column(1)[k].as_py())
            if stream.size >= STREAM_WORDS:
                yield stream
                stream = _Stream(plant)
    if stream.docs:
        yield stream


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for stream in _streams(batches, False):
        found = stream.catch()
        cols = [pa.array([[r[k] for r in runs] for _, _, runs in found], pa.list_(pa.int64())) for k in range(3)]
        ids = pa.array([i for i, _, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "starts", "lengths", "periods"])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, starts, lengths, periods`` (by start, then period) for every row.

    Words are what ASCII white space separates, compared byte by byte and case by
    case.  Null text has no words and no runs; ids may be null; rows that repeat are
    each returned; an empty table gives an empty result; other columns are not read."""
    return _slim(docs, id_col, text_col).mapInArrow(_run_rows, RUNS)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """For every row: number of runs, the longest (ties: least start, then period; nulls
    if none), digests of all runs and of the text without repeated periods.  ``plant``
    repeats words in a tenth of the documents first, by their ids (a null id: never).
    Other cases as in ``find_runs``."""
    return _slim(docs, id_col, text_col).mapInArrow(_run_digests(plant), RESULT)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, after the repeats that the query plants by id."""
    return run_digests(table(spark, sf_dir, "documents"), plant=True)
