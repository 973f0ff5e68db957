"""Hierarchical Pitman-Yor language model (bigrams), trained and applied on Spark.

Restaurants: one per context word, all sharing the unigram restaurant as parent,
whose base is uniform over the training vocabulary and one unknown word.  A
customer of a context restaurant is a training token; every table it opens sends
one customer to the parent.

Seating is sampled by Gibbs: in a sweep each dish of each restaurant is reseated
given the other dishes' tables (the restaurant's table total) and the parent's
predictive probability of the sweep before, customer by customer as in the
Chinese restaurant.  The next customer to open a table is drawn directly: given t
tables and b = i - d*t, its distance is beta-geometric with (A, b), where
A = (theta + d*T) * P_parent(w), so a dish costs a step per table, not per
customer.  Dishes are rows, so no restaurant has to fit into a task.  A dish draws its
random numbers by hashes of its words, the sweep and the draw, so the model is the
same however rows are partitioned and whenever a task is run again.  After
``burn_in`` sweeps each sample's predictive probabilities are averaged.

Words are keyed by their 64-bit XXH64; two words that share one would count as one.
Trained words are numbered, common ones first, so that a pair is one integer.  Pairs
travel as blocks: a chunk of texts sends its distinct pairs, sorted and packed, to
buckets of the hash of the pair, where counts are summed up; a scored chunk gets the
count and the tables of each pair it sent back in the order sent and adds up its texts.
A chunk's words meet the numbers and the model in a join; its tokens travel along, so
nothing is read twice to fit together and rows need no key of their own.  Texts go
through in rounds, by a hash, each with its share of the shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.llm import common
from quakes.llm.common import portions, remove, scratch, table

END = b" "  # cannot be a word; also the context before the first word
DISCOUNT, STRENGTH = (0.5, 0.75), (1.0, 1.0)  # unigram restaurant, context restaurants
CHUNK_DOCS, CHUNK_BYTES = 4096, 8 << 20  # counted together, a longer text alone
CODED_DOCS, CODED_BYTES = 16384, 16 << 20  # texts of a chunk
SEAT_ROWS = 200_000  # dishes seated together
BUCKET_TOKENS = 4_000_000  # training tokens to a bucket of pairs
TRAIN_ROUNDS, SCORE_ROUNDS = 2, 4  # the disk that shuffles take falls with them


def store(df: DataFrame, name: str) -> DataFrame:
    return common.store(df, name, drop_shuffles=True)


def word_id(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def token_ids(text: str | None) -> list[int]:
    return [word_id(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()] + [word_id(END)]


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, context and word of each token of ``texts``; context and word
    as numbers into the ids that follow.  Each distinct word is hashed once."""
    words = pc.ascii_split_whitespace(texts)
    found = words.flatten().dictionary_encode()
    lower = pc.ascii_lower(found.dictionary).dictionary_encode()
    names = lower.dictionary.cast(pa.binary()).to_pylist()
    ids = np.array([word_id(END), *map(word_id, names)], np.int64)  # the end is number 0
    code = 1 + lower.indices.to_numpy(zero_copy_only=False)[found.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    if b"" in names:  # white space at a text's ends
        kept = code != 1 + names.index(b"")
        code, text = code[kept], text[kept]
    ends = np.cumsum(np.bincount(text, minlength=len(texts)))
    w, text = np.insert(code, ends, 0), np.insert(text, ends, np.arange(len(texts)))
    return text, np.concatenate([[0], w[:-1]]), w, ids  # the end of a text is the context of the next one's first word


def _bigrams(per_doc: bool):
    """Distinct (row, context, word) of each text, or (context, word) of a chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for first, last in portions(texts, CHUNK_DOCS, CHUNK_BYTES):
                text, u, w, ids = _pairs(texts.slice(first, last - first))
                # by context and word, so that neighbours share them and shuffles compress
                many = last - first if per_doc else 1
                key, counts = np.unique((u * len(ids) + w) * many + text % many, return_counts=True)
                pairs, text = np.divmod(key, many)
                cols = {"u": pa.array(ids[pairs // len(ids)]), "w": pa.array(ids[pairs % len(ids)]), "n": pa.array(counts, pa.int32())}
                rows = {"row": b.column(0).slice(first, last - first).take(pa.array(text)).cast(pa.int64())} if per_doc else {}
                yield pa.RecordBatch.from_pydict(rows | cols)

    return run


def _pack(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; sorted or small ones take little."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(block: bytes, kind=np.int64) -> np.ndarray:
    n, size = int.from_bytes(block[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(block[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack_pairs(pairs: np.ndarray) -> bytes:
    """Sorted pairs: steps of the context; steps of the word within a context."""
    u, w = pairs >> 32, pairs & 0xFFFFFFFF
    du = np.diff(u, prepend=0)
    dw = np.where(du == 0, np.diff(w, prepend=0), w)
    return _pack(du * (1 << 32) + dw)


def _unpack_pairs(block: bytes) -> np.ndarray:
    step = _unpack(block)
    du, dw = step >> 32, step & 0xFFFFFFFF
    run = np.cumsum(dw)  # restarts where the context changes
    first = np.nonzero(du)[0]
    before = np.zeros(len(step), np.int64)
    if len(first):
        gaps = np.zeros(len(step), np.int64)
        base = run[first] - dw[first]
        gaps[first] = np.diff(base, prepend=0)
        before = np.cumsum(gaps)
    return (np.cumsum(du) << 32) + run - before


def _by_bucket(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted ``pairs`` by bucket, in which each bucket's stay sorted, and where each bucket starts."""
    bucket = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


CODED = "chunk long, local int, id long, tokens binary, lengths binary, rows array<bigint>"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chunk of texts a row per distinct word and one with the tokens (numbers of
    these words), the texts' lengths and ``row``; ``local`` is then the count of words."""
    part, made = TaskContext.get().partitionId(), 0
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        for first, last in portions(texts, CODED_DOCS, CODED_BYTES):
            text, _, w, ids = _pairs(texts.slice(first, last - first))
            often = np.argsort(-np.bincount(w, minlength=len(ids)), kind="stable")
            place = np.empty(len(ids), np.int32)
            place[often] = np.arange(len(ids), dtype=np.int32)
            tokens, lengths = _pack(place[w]), _pack(np.bincount(text, minlength=last - first))
            rows = b.column(0).slice(first, last - first).cast(pa.int64())
            # named by its contents too: a task run again on other rows would be found out
            chunk = word_id(b"%d %d " % (part, made) + tokens + lengths)
            made += 1
            n = len(ids)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(np.full(n + 1, chunk)),
                "local": pa.array(np.append(np.arange(n), n), pa.int32()),
                "id": pa.array(np.append(ids[often], chunk)),
                "tokens": pa.array([None] * n + [tokens], pa.binary()),
                "lengths": pa.array([None] * n + [lengths], pa.binary()),
                "rows": pa.array([None] * n + [rows.to_pylist()], pa.list_(pa.int64())),
            })


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each chunk of texts and their counts."""
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        for first, last in portions(texts, CODED_DOCS, CODED_BYTES):
            _, _, w, ids = _pairs(texts.slice(first, last - first))
            n = np.bincount(w, minlength=len(ids))  # none for the empty word, which Arrow finds at a text's ends
            yield pa.RecordBatch.from_pydict({"w": pa.array(ids[n > 0]), "n": pa.array(n[n > 0])})


def _opened(group: pa.Table) -> tuple[dict, pa.Table]:
    """A chunk without its words, and its words in order."""
    words = pa.Table.from_struct_array(group["words"].combine_chunks().flatten()).sort_by("local")
    (kit,) = group.drop_columns("words").to_pylist()
    if kit["tokens"] is None or kit["local"] != len(words):
        raise ValueError("a chunk of texts was read twice with different rows")
    return kit, words


def _known_pairs(tokens: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of contexts, whether context and word of a token are trained ones, their pairs;
    ``code`` is below zero for others."""
    end = tokens[-1]  # each text ends with it, and it is the context of the first word
    before = np.concatenate([[end], tokens[:-1]])
    u, w = code[before], code[tokens]
    known = (u >= 0) & (w >= 0)
    return before, known, (u[known] << 32) | w[known]


def _training_blocks(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        kit, words = _opened(group)
        _, _, found = _known_pairs(_unpack(kit["tokens"], np.int32), pc.fill_null(words["code"], -1).to_numpy())
        pairs, n = np.unique(found, return_counts=True)
        order, at = _by_bucket(pairs, buckets)
        parts = [(k, order[at[k] : at[k + 1]]) for k in range(buckets) if at[k] < at[k + 1]]
        return pa.table({
            "bucket": pa.array([k for k, _ in parts], pa.int32()),
            "pairs": pa.array([_pack_pairs(pairs[o]) for _, o in parts], pa.binary()),
            "n": pa.array([_pack(n[o]) for _, o in parts], pa.binary()),
        })

    return run


def _count_bucket(group: pa.Table) -> pa.Table:
    """One block of the pairs of a bucket and their counts."""
    found = np.concatenate([_unpack_pairs(b) for b in group["pairs"].to_pylist()])
    n = np.concatenate([_unpack(b) for b in group["n"].to_pylist()])
    order = np.argsort(found, kind="stable")
    found, n = found[order], n[order]
    first = np.nonzero(np.diff(found, prepend=-1))[0]
    blocks = {"pairs": [_pack_pairs(found[first])], "n": [_pack(np.add.reduceat(n, first))]}
    return pa.table({"bucket": group["bucket"].combine_chunks()[:1]} | {k: pa.array(v, pa.binary()) for k, v in blocks.items()})


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dishes with more than one customer."""
    for b in batches:
        for r in b.to_pylist():
            pairs, n = _unpack_pairs(r["pairs"]), _unpack(r["n"])
            pairs, n = pairs[n > 1], n[n > 1]
            bucket = np.full(len(n), r["bucket"], np.int32)
            yield pa.RecordBatch.from_pydict({"bucket": bucket, "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "c": n})


def _ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dishes with one customer: how many of a context, how many of a word."""
    for b in batches:
        for r in b.to_pylist():
            pairs = _unpack_pairs(r["pairs"])[_unpack(r["n"]) == 1]
            (a, of_a), (w, of_w) = (np.unique(x, return_counts=True) for x in (pairs >> 32, pairs & 0xFFFFFFFF))
            both = np.union1d(a, w)
            ones = np.zeros((2, len(both)), np.int64)
            ones[0, np.searchsorted(both, a)], ones[1, np.searchsorted(both, w)] = of_a, of_w
            yield pa.RecordBatch.from_pydict({"code": both, "ones_u": ones[0], "ones_w": ones[1]})


def _with_tables(counted: pa.Table, seated: pa.Table) -> pa.Table:
    """Adds the tables of each pair over all samples; of a single customer one in each."""
    if not len(counted):
        raise ValueError("tables of no pair")
    r = counted.to_pylist()[0]
    pairs, n = _unpack_pairs(r["pairs"]), _unpack(r["n"])
    t = np.where(n == 1, r["samples"], 0)
    place = np.searchsorted(pairs, (seated["a"].to_numpy() << 32) | seated["b"].to_numpy())
    t += np.bincount(place, seated["t"].to_numpy(), minlength=len(pairs)).astype(np.int64)
    return counted.select(["bucket", "pairs", "n"]).append_column("t", pa.array([_pack(t)], pa.binary()))


def _dishes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            pairs = _unpack_pairs(r["pairs"])
            yield pa.RecordBatch.from_pydict({"a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "c": _unpack(r["n"]), "t": _unpack(r["t"])})


ASKED = "chunk long, bucket int, pairs binary, tokens binary, lengths binary, rows array<bigint>, info array<binary>"
ANSWERED = "chunk long, bucket int, n binary, t binary, tokens binary, lengths binary, rows array<bigint>, info array<binary>"


def _ask(buckets: int, unknown: list[float]):
    """Blocks of a chunk's pairs of trained words, and a row to add them up by: the tokens
    and what is known of each word."""
    fill = {"code": -1, "k": 0} | {f"back_{s}": 1.0 for s in range(len(unknown))} | {f"p1_{s}": x for s, x in enumerate(unknown)}

    def run(group: pa.Table) -> pa.Table:
        kit, words = _opened(group)
        of = [pc.fill_null(words[c], x).to_numpy() for c, x in fill.items()]
        _, _, found = _known_pairs(_unpack(kit["tokens"], np.int32), of[0])
        pairs = np.unique(found)
        order, at = _by_bucket(pairs, buckets)
        parts = [(k, order[at[k] : at[k + 1]]) for k in range(buckets) if at[k] < at[k + 1]]
        n = len(parts)
        return pa.table({
            "chunk": pa.array([kit["chunk"]] * (n + 1), pa.int64()),
            "bucket": pa.array([k for k, _ in parts] + [kit["chunk"] % buckets], pa.int32()),
            "pairs": pa.array([_pack_pairs(pairs[o]) for _, o in parts] + [None], pa.binary()),
            "tokens": pa.array([None] * n + [kit["tokens"]], pa.binary()),
            "lengths": pa.array([None] * n + [kit["lengths"]], pa.binary()),
            "rows": pa.array([None] * n + [kit["rows"]], pa.list_(pa.int64())),
            "info": pa.array([None] * n + [[_pack(x) for x in of]], pa.list_(pa.binary())),
        })

    return run


def _answer(asked: pa.Table, seen: pa.Table) -> pa.Table:
    """Counts and tables of the pairs asked for, in their order; zero for pairs not trained."""
    known = seen.to_pylist()[0] if len(seen) and len(asked) else None
    if known:
        pairs, values = _unpack_pairs(known["pairs"]), [np.append(_unpack(known[c]), 0) for c in ("n", "t")]
    out: list[list] = [[], []]
    for block in asked["pairs"].to_pylist():
        if block is None or not known:
            zero = None if block is None else _pack(np.zeros(int.from_bytes(block[:8], "little"), np.int64))
            found = [zero, zero]
        else:
            want = _unpack_pairs(block)
            at = np.searchsorted(pairs, want)
            at[pairs[np.minimum(at, len(pairs) - 1)] != want] = len(pairs)
            found = [_pack(v[at]) for v in values]
        for column, x in zip(out, found, strict=True):
            column.append(x)
    kept = {c: asked[c] for c in ("tokens", "lengths", "rows", "info")}
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], **{c: pa.array(x, pa.binary()) for c, x in zip("nt", out, strict=True)}, **kept})


SUMS = "row long, n_tokens long, n_known long, base_score double, score double"


def _add_up(buckets: int, samples: int, total: float):
    """Sums of each text of a chunk."""
    d, theta = DISCOUNT[1], STRENGTH[1]

    def run(group: pa.Table) -> pa.Table:
        whole = pc.is_valid(group["tokens"])
        (kit,) = group.filter(whole).to_pylist()
        answers = {r["bucket"]: r for r in group.filter(pc.invert(whole)).select(["bucket", "n", "t"]).to_pylist()}
        tokens, lengths = _unpack(kit["tokens"], np.int32), _unpack(kit["lengths"])
        code, k = (_unpack(x) for x in kit["info"][:2])
        floats = [_unpack(x, float) for x in kit["info"][2:]]
        back, p1 = floats[:samples], floats[samples:]
        before, known, found = _known_pairs(tokens, code)
        pairs, which = np.unique(found, return_inverse=True)
        order, at = _by_bucket(pairs, buckets)
        own = np.zeros(len(pairs))
        for b in range(buckets):
            if at[b] < at[b + 1]:
                own[order[at[b] : at[b + 1]]] = _unpack(answers[b]["n"]) - d * _unpack(answers[b]["t"]) / samples
        p = sum(back[s][before] * p1[s][tokens] for s in range(samples)) / samples
        p[known] += own[which] / (theta + k[before[known]])
        text = np.repeat(np.arange(len(lengths)), lengths)
        count = k[tokens]
        sums = [np.bincount(text, x, len(lengths)) for x in (count > 0, np.log10((count + 1) / total), np.log10(p))]
        return pa.table({
            "row": pa.array(kit["rows"], pa.int64()), "n_tokens": lengths, "n_known": sums[0].astype(np.int64),
            "base_score": sums[1], "score": sums[2],
        })

    return run


def _uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each key and draw, the same wherever it is drawn."""
    x = keys + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _gamma(shape: np.ndarray, keys: np.ndarray, draw: int) -> np.ndarray:
    """Gamma variates (Marsaglia and Tsang; a shape below one is raised by one and
    scaled), each from its own key: 64 draws from ``draw`` on are its own."""
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, open_ = d.copy(), np.arange(len(shape))
    for attempt in range(0, 60, 3):  # each accepts 95 of 100; after the last the mode stands
        if not len(open_):
            break
        k = keys[open_]
        radius = np.sqrt(-2 * np.log(_uniform(k, draw + attempt)))
        x = radius * np.cos(2 * np.pi * _uniform(k, draw + attempt + 1))
        v = (1 + c[open_] * x) ** 3
        good = v > 0
        good[good] = np.log(_uniform(k[good], draw + attempt + 2)) < 0.5 * x[good] ** 2 + d[open_][good] * (1 - v[good] + np.log(v[good]))
        out[open_[good]] = d[open_[good]] * v[good]
        open_ = open_[~good]
    if small.any():
        out[small] *= _uniform(keys[small], draw + 63) ** (1 / shape[small])
    return np.maximum(out, 1e-300)


def seat(customers: np.ndarray, open_weight: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of dishes with so many customers, seated one after another; a dish draws
    by its key, so its tables do not depend on the dishes beside it."""
    c = customers.astype(np.int64)
    tables, seated = np.minimum(c, 1), np.minimum(c, 1).copy()
    live, step = np.nonzero(c > 1)[0], 0
    while len(live):
        k = keys[live]
        x = _gamma(np.maximum(open_weight[live], 1e-300), k, 200 * step)
        y = _gamma(seated[live] - discount * tables[live], k, 200 * step + 64)
        chance = np.clip(x / (x + y), 1e-18, 1 - 1e-16)
        u = _uniform(k, 200 * step + 128)
        gap = np.minimum(np.ceil(np.log(u) / np.log1p(-chance)), 1e18).astype(np.int64)
        seated[live] += np.minimum(np.maximum(gap, 1), c[live])  # the customer who opens the next table
        live = live[seated[live] <= c[live]]
        tables[live] += 1
        live = live[seated[live] < c[live]]
        step += 1
    return tables


def _dish_keys(frame: pd.DataFrame, seed: int) -> np.ndarray:
    """A key per dish from its words and the sweep."""
    keys = np.full(len(frame), np.uint64(seed * 0x2545F491 + 1))
    for c in ("u", "w"):
        if c in frame:
            keys = (keys ^ frame[c].to_numpy(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            keys ^= keys >> np.uint64(33)
    return keys


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames put together up to about SEAT_ROWS: seating takes a step for each table of
    the fullest dish, whether few dishes are left by then or many."""
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= SEAT_ROWS:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _seat_rows(discount: float, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _joined(frames):
            f = f.assign(t=seat(f["c"].to_numpy(), f["open"].to_numpy(), discount, _dish_keys(f, seed)))
            yield f.drop(columns="open")

    return run


def seat_dishes(dishes: DataFrame, discount: float, seed: int) -> DataFrame:
    """``dishes`` (``w``, ``c``, ``open``, more) with ``t`` in place of ``open``."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dishes.schema if f.name != "open")
    return dishes.mapInPandas(_seat_rows(discount, seed), fields + ", t long")


def _parent(customers: DataFrame, vocabulary: int, tables_before: float, seed: int) -> DataFrame:
    """``w, code, p1``: predictive probabilities of the unigram restaurant with ``customers`` (w, code, c)."""
    d, theta = DISCOUNT[0], STRENGTH[0]
    base = 1.0 / (vocabulary + 1)
    seated = store(seat_dishes(customers.withColumn("open", F.lit((theta + d * tables_before) * base)), d, seed), "parent")
    c, t = seated.agg(F.sum("c"), F.sum("t")).first()
    c, t = c or 0, t or 0
    share = (theta + d * t) / (theta + c)
    p = (F.col("c") - d * F.col("t")) / (theta + c) + share * base
    return seated.select("w", "code", p.alias("p1")), share * base, t


class Model:
    """Tables of a trained model: ``contexts`` (u, code, cu, back_1..back_S), ``words``
    (w, code, k = base count, back_1.., p1_1..p1_S), ``blocks`` (bucket, pairs of codes, their
    counts, their tables over all samples), and the scalars."""

    def __init__(self, blocks, contexts, words, unknown, tokens, vocabulary, buckets):
        self.blocks, self.contexts, self.words, self.buckets = blocks, contexts, words, buckets
        self.unknown, self.tokens, self.vocabulary = unknown, tokens, vocabulary

    @property
    def seen(self) -> DataFrame:
        """``u, w, k, p`` of every pair seen in training."""
        d, theta, samples = DISCOUNT[1], STRENGTH[1], len(self.unknown)
        pairs = self.blocks.mapInArrow(_dishes_of, "a long, b long, c long, t long")
        words = self.words.select("w", F.col("code").alias("b"), "k", *(f"p1_{s}" for s in range(samples)))
        pairs = pairs.join(self.contexts.withColumnRenamed("code", "a"), "a").join(words, "b")
        own = (F.col("c") - F.col("t") * (d / samples)) / (theta + F.col("cu"))
        shared = reduce(Column.__add__, [F.col(f"back_{s}") * F.col(f"p1_{s}") for s in range(samples)]) / samples
        return pairs.select("u", "w", "k", (own + shared).alias("p"))


def _rounds(texts: DataFrame, rounds: int) -> list[DataFrame]:
    """Shares of ``texts`` by a hash of the row: each is worked on before the next."""
    share = F.pmod(F.xxhash64("row", "text"), F.lit(rounds))
    return [texts.where(share == r) for r in range(rounds)]


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with a number each from 0 on, common ones first in each partition, stored."""
    placed = store(words.sortWithinPartitions(F.desc("k")).withColumn("place", F.monotonically_increasing_id()), "places")
    parts = (placed.agg(F.max(F.shiftright("place", 33))).first()[0] or 0) + 1
    code = F.expr("place & ((1L << 33) - 1)") * parts + F.shiftright("place", 33)
    return store(placed.select("w", "k", code.alias("code")), "words")


def _met(texts: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each chunk of ``texts``; its words have the columns of ``words`` (w, more)."""
    rows = texts.select("row", "text").mapInArrow(_coded, CODED)
    met = rows.join(words, rows["id"] == words["w"], "left")
    word = F.when(F.col("tokens").isNull(), F.struct("local", *(c for c in words.columns if c != "w")))
    kit = [F.first(c, ignorenulls=True).alias(c) for c in ("tokens", "lengths", "rows")]
    return met.groupBy("chunk").agg(F.max("local").alias("local"), *kit, F.collect_list(word).alias("words"))


def train(texts: DataFrame, samples: int = 2, burn_in: int = 1, seed: int = 11) -> Model:
    """``texts`` has ``row`` and ``text``; every row is read whole."""
    d, theta = DISCOUNT[1], STRENGTH[1]
    with scratch() as made:  # not needed by the model
        counted = texts.select("row", "text").mapInArrow(_words, "w long, n long")
        words = _numbered(counted.groupBy("w").agg(F.sum("n").alias("k")))
        spark, numbering = texts.sparkSession, made[:-1]
        tokens, vocabulary = words.agg(F.sum("k"), F.count("*")).first()
        tokens = tokens or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET_TOKENS)
        pairs_of = _training_blocks(buckets)
        with scratch() as passing:
            blocks = [
                store(_met(part, words.select("w", "code")).groupBy("chunk").applyInArrow(pairs_of, "bucket int, pairs binary, n binary"), "blocks")
                for part in _rounds(texts, TRAIN_ROUNDS)
            ]
        sent = reduce(DataFrame.union, blocks)
        counts = store(sent.groupBy("bucket").applyInArrow(_count_bucket, "bucket int, pairs binary, n binary"), "bigrams")
        remove(spark, numbering + passing)
        # dishes with one customer have one table in any seating: only their sums are needed
        many = store(counts.mapInArrow(_many, "bucket int, a long, b long, c long"), "reseated")
        ones = counts.mapInArrow(_ones, "code long, ones_u long, ones_w long")
        ones = ones.groupBy("code").agg(F.sum("ones_u").alias("ones_u"), F.sum("ones_w").alias("ones_w"))
        # a word is followed by one, the end of a text by the next text's first: its customers are its own count
        ones = store(words.join(ones, "code", "left").fillna(0), "ones")
        seating, top_tables = many.withColumn("t", F.lit(1).cast("long")), float(vocabulary or 0)

        def sitting(of: str, ones_of: str, name: str) -> DataFrame:
            more = seating.groupBy(F.col(of).alias("code")).agg(F.sum("t").alias("t"))
            return ones.join(more, "code", "left").select("w", "code", (F.col(ones_of) + F.coalesce("t", F.lit(0))).alias(name))

        totals = sitting("a", "ones_u", "tu")
        p1s, backs, seatings, unknown = [], [], [], []
        before: list[str] = []
        for sweep in range(burn_in + samples):
            with scratch() as now:
                p1, other, top_tables = _parent(sitting("b", "ones_w", "c"), vocabulary or 0, top_tables, seed + 2 * sweep)
                weight = (theta + d * F.col("tu")) * F.col("p1")
                dishes = many.join(totals.select(F.col("code").alias("a"), F.col("w").alias("u"), "tu"), "a")
                dishes = dishes.join(p1.withColumnRenamed("code", "b"), "b").select("bucket", "a", "b", "u", "w", "c", weight.alias("open"))
                seating = store(seat_dishes(dishes, d, seed + 2 * sweep + 1).drop("u", "w"), "seating")
                totals = store(sitting("a", "ones_u", "tu"), "totals")
            remove(spark, before)  # of a sweep that is not averaged
            before = now if sweep < burn_in else []
            if sweep >= burn_in:
                p1s.append(p1)
                unknown.append(other)
                backs.append(totals)
                seatings.append(seating)
    context = words.select(F.col("w").alias("u"), "code", F.col("k").alias("cu"))
    for s in range(samples):
        context = context.join(backs[s].select("code", F.col("tu").alias(f"tu_{s}")), "code")
    back = [((theta + d * F.col(f"tu_{s}")) / (theta + F.col("cu"))).alias(f"back_{s}") for s in range(samples)]
    context = store(context.select("u", "code", "cu", *back), "context_model")
    word_model = context.withColumnsRenamed({"u": "w", "cu": "k"})  # the same words: joined once for all that is scored
    for s in range(samples):
        word_model = word_model.join(p1s[s].select("code", F.col("p1").alias(f"p1_{s}")), "code")
    word_model = store(word_model, "word_model")
    seated = reduce(DataFrame.union, [x.select("bucket", "a", "b", "t") for x in seatings])
    seen = counts.withColumn("samples", F.lit(samples)).groupBy("bucket").cogroup(seated.groupBy("bucket"))
    seen = store(seen.applyInArrow(_with_tables, "bucket int, pairs binary, n binary, t binary"), "seen")
    remove(spark, made)
    return Model(seen, context, word_model, unknown, tokens, vocabulary, buckets)


def score(texts: DataFrame, m: Model) -> DataFrame:
    """``row, n_tokens, n_known, base_score, score`` of every text; ``row`` may repeat or be null."""
    samples, total = len(m.unknown), float(m.tokens + m.vocabulary + 1)
    asked = _met(texts, m.words).groupBy("chunk").applyInArrow(_ask(m.buckets, m.unknown), ASKED)
    answered = asked.groupBy("bucket").cogroup(m.blocks.groupBy("bucket")).applyInArrow(_answer, ANSWERED)
    return store(answered.groupBy("chunk").applyInArrow(_add_up(m.buckets, samples, total), SUMS), "scores")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on the documents not held out and score all: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score, perplexity (per token, 10-based score).

    Null text counts as empty: the end alone.  Rows that repeat are each counted and
    scored.  If every document is held out all words are unknown.  An empty table
    gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    m = train(rows.where(~held_out("row")), **options)
    scores = reduce(DataFrame.union, [score(part, m) for part in _rounds(rows, SCORE_ROUNDS)])
    return scores.select(
        F.col("row").alias("doc_id"),
        held_out("row").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(m.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op2_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
