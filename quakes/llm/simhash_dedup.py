"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at ``max_bits`` (2 or fewer) differing bits.  A
fingerprint is cut into three segments of 22, 21 and 21 bits.  Two errors leave
one of three segments exact (pigeonhole), and any other segment has two errors or
fewer, hence a word halfway that is one bit or less from both sides.  Each segment
is decoded with the perfect (23,12) Golay code: the codeword indices of all words
within one bit of it, one or six of them, are its keys, so two segments within two
errors share at least one.  A candidate key is (exact segment, codeword index of the
next segment): about 16 keys of 33 bits per distinct fingerprint, and no link is
missed.

Candidates are joined within a key and verified by bit distance.  A key with more
than ``pair_limit`` distinct fingerprints is not paired: its members are grouped by
the words within one bit of them (65 each), which two fingerprints share exactly
when they differ in two bits or fewer, so the rows stay linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import ROW, components, keep_rows, numbered, store, table

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b101011100011  # of the (23,12) Golay code: x^11+x^9+x^7+x^6+x^5+x+1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words.
    Long texts are counted in blocks, so memory follows the word list only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = words[at : min(at + 65536, n) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [tuple(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            more = dict(zip(b.schema.names[2:], b.columns[2:], strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp.view(np.int64)), **more})

    return run


def syndrome_table() -> np.ndarray:
    """Error word of least weight for each of the 2048 syndromes (weights 0 to 3)."""
    unit = np.array([_remainder(1 << i) for i in range(23)])
    errors = np.zeros(2048, np.int64)
    for a in range(23):
        errors[unit[a]] = 1 << a
        for b in range(a):
            errors[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return errors


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def codeword_index(words: np.ndarray, errors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest codeword (its systematic bits)."""
    return (words ^ errors[low[words & 2047] ^ high[words >> 11]]) >> 11


def candidate_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys, distinct per row."""
    errors = syndrome_table()
    low = np.array([_remainder(i) for i in range(2048)])
    high = np.array([_remainder(i << 11) for i in range(4096)])
    near = np.concatenate([[0], 1 << np.arange(23)])
    seg = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        exact, fuzzy = seg[k], seg[(k + 1) % 3]
        index = np.sort(codeword_index(fuzzy[:, None] ^ near[None, :], errors, low, high), axis=1)
        new = np.concatenate([np.ones((len(fps), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(np.int64(k) << 40 | exact[r] << 12 | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy(np.int64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            rows, keys = candidate_keys(part.view(np.uint64))
            yield pd.DataFrame({"fp": part[rows], "key": keys})


def simhash_links(fps: DataFrame, max_bits: int = 2, pair_limit: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``): every link
    is in them or follows from them."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the Golay keys promise two errors at most")
    entries = store(fps.mapInPandas(_keys, "fp long, key long"), "golay_keys")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = store(entries.join(sizes, "key"), "golay_shared")
    few = crowded.where(F.col("n") <= pair_limit)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    # words within one bit: shared by two fingerprints exactly when they link (two bits);
    # for one bit or none the fingerprint itself is the word, met by the other's flips
    many = crowded.where(F.col("n") > pair_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    balls = many.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), (F.col("flip") == 0).alias("own")
    )
    if max_bits == 2:
        hub = balls.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
        stars = balls.join(hub, "word").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    elif max_bits == 1:
        own = balls.where("own").select("word", F.col("fp").alias("a"))
        stars = balls.where("NOT own").join(own, "word").select("a", F.col("fp").alias("b"))
    else:
        stars = many.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    return pairs.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rows_and_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    pair_limit: int = 64,
    carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` and the columns ``carry`` (long) of every row, and ``fp, root,
    component_id`` of every fingerprint."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    schema = ", ".join(["doc_id long, fp long", *(f"{c} long" for c in carry)])
    rows = store(slim.mapInArrow(_fingerprints(shingle), schema), "fingerprints")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    links = simhash_links(classes.select("fp"), max_bits, pair_limit)
    root = components(links, "a", "b")
    rooted = classes.join(root, classes["fp"] == root["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows, store(rooted.join(least, "root").select("fp", "root", "component_id"), "components")


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Null text counts as empty; texts without words have fingerprint zero and link
    like any other.  A row with a null id is kept in the result and never names a
    component unless its component has no other id.  Rows that repeat are each
    returned.  An empty table gives an empty result.
    """
    rows, named = _rows_and_components(docs, **options)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component: of the id that names it, of that id's
    rows in the component the first.  Rows are told apart by a key of their own, so
    ids may repeat, under one text or several, and be null."""
    numbers = numbered(docs)
    rows, named = _rows_and_components(numbers, carry=(ROW,), **options)
    first = rows.groupBy("fp", "doc_id").agg(F.min(ROW).alias(ROW)).withColumnRenamed("fp", "row_fp")
    naming = first.join(named, (F.col("row_fp") == F.col("fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return keep_rows(numbers, naming.groupBy("root").agg(F.min(ROW).alias(ROW)))


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
