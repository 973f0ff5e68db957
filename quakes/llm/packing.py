"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenized whole; only those longer than a sequence are cut.  Full
pieces are sequences of their own.  The rest are dealt into shards of about
``shard_pieces`` by a hash of their row, and each shard is packed by ``islands``
populations: an individual is a set of bins; crossover puts the well-filled bins of
one parent into the other, drops the bins that hold duplicates of them and best-fits
the displaced pieces again, where a displaced piece may take the place of one or two
smaller ones that fill a bin less.  Between rounds each island's elite migrates to the
next island of its shard through a shuffle.  Islands start from one best-fit packing of
their shard; a shard where it meets the lower bound ceil(tokens / capacity), which no
packing beats, is done, and an island ends early when its elite meets it.
"""

from __future__ import annotations

import bisect
import random
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import once_per_worker, portions, store, table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose normal form is their lower case and whose boundaries are those of UNIT.
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
NOT_PLAIN = "[^!-&(-;=-~À-ÖØ-öø-ÿ]"
PLAIN_BYTES = bytes(b for b in range(256) if b == 32 or PLAIN.fullmatch(chr(b)))  # and a space, in Latin-1
UNIT = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+| ")
WORD_END = "</w>"
CACHE_WORDS = 200_000  # in each of a task's two cache generations
CACHE_UNITS = 150_000  # likewise of units
CACHE_CHARS = 48
REFILL_PASSES = 4
MOST_TASKS = 10_000
BATCH_WORDS = 20_000  # encoded at a time, which bounds the tokenizer's memory
BATCH_TEXTS, BATCH_BYTES = 4096, 4 << 20  # whose words are looked up together, a longer text alone
SPACE_ID = (1 << 32) - 1  # of no token


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(words: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN_BYTES)
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """Ids of whole texts, from those of their distinct words.

    For tokenizers that lower-case, drop white space, separate letters, single digits
    and symbols, and end each of these units with ``WORD_END``: white space is then a
    boundary no token crosses, and a text's ids are those of its words.  Latin-1 words
    without ``'`` and ``<`` are looked up by their units, and unknown units go past the
    tokenizer's normaliser, which would leave them as they are; other words are looked
    up whole.  Two generations of each bound what is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {" ": struct.pack("<I", SPACE_ID)}
        self.older_units: dict[str, bytes] = {}
        probe = "Ab12 \n (É,) ab"
        if self._full([probe])[0] != b"".join(self._units(["ab", "1", "2", "(", "é", ",)", "ab"])):
            raise ValueError("a tokenizer of lower-case units is needed")

    def _full(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), BATCH_WORDS):
            for e in self.tok.encode_batch_fast(words[at : at + BATCH_WORDS], add_special_tokens=False):
                out.append(struct.pack(f"<{len(e)}I", *e.ids))
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of lower-case units, which the tokenizer reads as one text."""
        out: list[bytes] = []
        for at in range(0, len(units), BATCH_WORDS):
            part = units[at : at + BATCH_WORDS]
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) != len(part):
                raise ValueError("a unit has no end of its own")
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the places where each begins (and the
        last ends)."""
        words = pc.ascii_split_whitespace(texts)
        found = words.flatten().dictionary_encode()
        of_words, place = self._words(found.dictionary)
        # bytes of words put one after another by Arrow
        taken = of_words.take(pa.array(place[found.indices.to_numpy(zero_copy_only=False)]))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1) // 4
        return np.frombuffer(data or b"", "<u4", ends[-1]), ends[words.offsets.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """An array with the ids of each word as bytes, and each word's place there."""
        joined, other, place = _joined(words), [], np.arange(len(words))
        if not _plain(joined) or (pc.max(pc.utf8_length(words)).as_py() or 0) > CACHE_CHARS:
            whole = pc.or_(pc.greater(pc.utf8_length(words), CACHE_CHARS), pc.match_substring_regex(words, NOT_PLAIN))
            other = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            joined = _joined(pc.if_else(whole, "", words))
        parts = UNIT.findall(joined.lower())
        ids = np.frombuffer(b"".join(map(self._known_units(set(parts)).__getitem__, parts)), "<u4")
        space = ids == SPACE_ID
        cut = np.flatnonzero(space)
        ends = 4 * np.concatenate([[0], cut - np.arange(len(cut)), [len(ids) - len(cut)]])
        of_words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids[~space])])
        if len(other):
            place[other] = len(of_words) + np.arange(len(other))
            of_words = pa.concat_arrays([of_words, pa.array(self._known_words(words.take(pa.array(other)).to_pylist()), pa.large_binary())])
        return of_words, place

    def _known_units(self, units: set[str]) -> dict[str, bytes]:
        """Ids of at least these units; new ones go to the tokenizer."""
        if len(self.units) >= CACHE_UNITS:
            self.older_units, self.units = self.units, {" ": self.units[" "]}
        new = units.difference(self.units)
        self.units.update((u, self.older_units[u]) for u in new if u in self.older_units)
        new = [u for u in new if u not in self.older_units]
        self.units.update(zip(new, self._units(new), strict=True))
        return self.units

    def _known_words(self, words: list[str]) -> list[bytes]:
        """Ids of these words; new ones go to the tokenizer, and all but long ones are remembered."""
        if len(self.cache) >= CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        out = {w: self.cache.get(w) or self.older.get(w) for w in words}
        new = [w for w, ids in out.items() if ids is None]
        out.update(zip(new, self._full(new), strict=True))
        self.cache.update((w, out[w]) for w in words if len(w) <= CACHE_CHARS)
        return [out[w] for w in words]


def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return once_per_worker(("word_encoder", path), lambda: WordEncoder(path))


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        encoder = word_encoder(path)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for lo, hi in portions(texts, BATCH_TEXTS, BATCH_BYTES):
                out: list[tuple] = []
                found, at = encoder.encode_all(texts.slice(lo, hi - lo))
                for d, doc_id in enumerate(b.column(0).slice(lo, hi - lo).to_pylist()):
                    data = np.append(found[at[d] : at[d + 1]], np.array([END_ID], "<u4"))
                    for k, start in enumerate(range(0, len(data), capacity)):
                        p = data[start : start + capacity]
                        row = (uid, doc_id, k, start, len(p), zlib.crc32(p))
                        out.append((*row, p.astype(np.int32)) if with_ids else row)
                        uid += 1
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types[: len(cols)], strict=True)], names=names[: len(cols)]
                )

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(_cut(tokenizer, capacity, with_ids), schema)


# --- one island: plain Python over one bounded shard ---------------------------


def best_fit(items: list[int], length: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Put ``items`` (longest first) into the fullest bin that takes them."""
    room = sorted((capacity - sum(length[i] for i in b), k) for k, b in enumerate(bins))
    bins = [list(b) for b in bins]
    for i in sorted(items, key=lambda x: (-length[x], x)):
        at = bisect.bisect_left(room, (length[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - length[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            bisect.insort(room, (left - length[i], k))
    return bins


def fitness(bins: list[list[int]], length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square fill)."""
    return -len(bins), sum((sum(length[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def refill(displaced: list[int], bins: list[list[int]], length: list[int], capacity: int) -> list[list[int]]:
    """Put ``displaced`` back: where a displaced piece fills a bin better than one or two
    of its pieces they change places, so ever smaller pieces are left for best fit."""
    bins = [list(b) for b in bins]
    free = sorted((length[i], i) for i in displaced)
    lengths = [n for n, _ in free]
    room = [capacity - sum(length[i] for i in b) for b in bins]
    for _ in range(REFILL_PASSES):
        changed = False
        for k in sorted((k for k, r in enumerate(room) if r), key=lambda k: room[k]):
            items, space, best = bins[k], room[k], None
            sizes = [length[x] for x in items]
            totals = [*sizes, *(a + b for a, b in combinations(sizes, 2))]
            most = 0
            for n, total in enumerate(totals):
                at = bisect.bisect_right(lengths, space + total) - 1
                if at >= 0 and lengths[at] - total > most:
                    most = lengths[at] - total
                    best = most, at, n
                    if most == space:
                        break
            if best:
                gain, at, n = best
                out = (items[n],) if n < len(items) else next(islice(combinations(items, 2), n - len(items), None))
                _, i = free.pop(at)
                lengths.pop(at)
                for x in out:
                    items.remove(x)
                    to = bisect.bisect_left(free, (length[x], x))
                    free.insert(to, (length[x], x))
                    lengths.insert(to, length[x])
                items.append(i)
                room[k] -= gain
                changed = True
        if not changed:
            break
    return best_fit([i for _, i in free], length, capacity, bins)


def crossover(a, b, length, capacity, rng):
    """Bins of ``a``, the fuller the likelier, injected into ``b``."""
    fill = [sum(length[i] for i in x) / capacity for x in a]
    given = [x for x, f in zip(a, fill, strict=True) if rng.random() < 0.5 * f**8]
    held = {i for x in given for i in x}
    kept = [x for x in b if held.isdisjoint(x)]
    displaced = [i for x in b if not held.isdisjoint(x) for i in x if i not in held]
    return refill(displaced, given + kept, length, capacity)


def mutate(bins, length, capacity, rng):
    """Empty the emptiest bin and a few others, and put their pieces back."""
    order = sorted(range(len(bins)), key=lambda k: sum(length[i] for i in bins[k]))
    gone = {order[0], *(rng.randrange(len(bins)) for _ in range(min(3, len(bins))))}
    return refill([i for k in gone for i in bins[k]], [b for k, b in enumerate(bins) if k not in gone], length, capacity)


def evolve(length: list[int], starts, capacity: int, generations: int, population: int, rng) -> list[list[int]]:
    bound = -(-sum(length) // capacity)
    rated = lambda x: (fitness(x, length, capacity), x)
    first = lambda r: r[0]
    pool = [rated(x) for x in starts or [best_fit(list(range(len(length))), length, capacity, [])]]
    best = max(pool, key=first)[1]
    if len(best) <= bound:
        return best
    while len(pool) < population:
        pool.append(rated(mutate(rng.choice(pool)[1], length, capacity, rng)))
    for _ in range(generations):
        (_, a), (_, b) = (max(rng.sample(pool, 2), key=first) for _ in range(2))
        child = crossover(a, b, length, capacity, rng)
        if rng.random() < 0.3:
            child = mutate(child, length, capacity, rng)
        child = rated(child)
        worst = min(range(len(pool)), key=lambda k: pool[k][0])
        if child[0] > pool[worst][0]:
            pool[worst] = child
        if len(child[1]) <= bound:
            break
    return max(pool, key=first)[1]


def _island(capacity: int, generations: int, population: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(k) for k in key)
        own = pdf[pdf["origin"] == pdf["origin"].min()].sort_values("uid")
        number = {u: k for k, u in enumerate(own["uid"])}
        length = own["length"].tolist()
        starts = []
        for _, part in pdf[pdf["bin"] >= 0].groupby("origin"):
            bins: dict[int, list[int]] = {}
            for u, b in zip(part["uid"], part["bin"], strict=True):
                bins.setdefault(b, []).append(number[u])
            starts.append(list(bins.values()))
        best = evolve(length, starts, capacity, generations, population, random.Random(f"{seed}/{shard}/{island}"))
        uid = own["uid"].tolist()
        out = []
        for b, items in enumerate(best):
            at = 0
            for i in items:
                out.append((shard, island, uid[i], length[i], b, at))
                at += length[i]
        return pd.DataFrame(out, columns=["shard", "island", "uid", "length", "bin", "offset"])

    return run


SOLUTION = "shard long, island int, uid long, length long, bin int, offset long"


def _islands(state: DataFrame, groups: int, run) -> DataFrame:
    """Each island in a task of its own up to MOST_TASKS: the rows are few, the work is not."""
    return state.repartition(min(groups, MOST_TASKS), "shard", "island").groupBy("shard", "island").applyInPandas(run, SOLUTION)


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    shard_pieces: int = 8192,
    islands: int = 2,
    rounds: int = 2,
    generations: int = 40,
    population: int = 6,
    seed: int = 0,
) -> DataFrame:
    """``uid, sequence_id, offset`` for stored ``pieces`` (``uid``, ``length``)."""
    open_ = pieces.where(F.col("length") < capacity).select("uid", "length")
    shards = max(1, -(-open_.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard")
    # one best-fit packing of each shard; a shard that meets its bound is done
    first = open_.select(shard, F.lit(0).alias("island"), "uid", "length", F.lit(-1).alias("bin"), F.lit(0).alias("origin"))
    solved = store(_islands(first, shards, _island(capacity, 0, 1, seed)), "first_fit")
    missed = solved.groupBy("shard").agg((F.max("bin") + 1).alias("bins"), F.sum("length").alias("tokens"))
    missed = store(missed.where(F.col("bins") > F.ceil(F.col("tokens") / capacity)).select("shard"), "missed")
    packed = solved.join(missed, "shard", "left_anti").select("shard", "uid", "bin", "offset")
    if hard := missed.count():
        solved = solved.join(missed, "shard", "left_semi")
        moves = F.array(*(F.lit(k) for k in range(islands)))
        for r in range(rounds):
            state = solved.select(
                "shard", F.explode(F.array_distinct(moves)).alias("to"), "uid", "length", "bin", F.col("island").alias("origin")
            ).withColumnRenamed("to", "island")
            evolved = _islands(state, hard * islands, _island(capacity, generations, population, seed + r))
            solved = store(evolved, "islands")
            moves = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        elite = solved.groupBy("shard", "island").agg(F.max("bin").alias("bins"))
        elite = elite.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("e")).select("shard", F.col("e.island").alias("island"))
        packed = packed.unionByName(solved.join(elite, ["shard", "island"], "left_semi").select("shard", "uid", "bin", "offset"))
    packed = packed.select("uid", (F.col("shard") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") >= capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False, **options
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids``).  Null or empty text is the end id alone; a null id stays null;
    rows that repeat are packed each; an empty table gives an empty result."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    capacity = options.get("capacity", CAPACITY)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = store(cut_pieces(slim, path, capacity, with_ids), "pieces")
    return pieces.join(pack(pieces, **options), "uid").drop("uid")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
