"""SentencePiece encoding with offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character
map (a double-array trie with its replacement strings); every normalised character
keeps the byte where its source began, so each piece projects to a span of the
original bytes.  Merges run by score, leftmost first, within chunks that no piece
of the vocabulary crosses; characters without a piece fall back to bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import once_per_worker, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE_ENTRIES = 150_000  # chunks in each of a task's two cache generations
CACHE_CHARS = 48
SHORT = 64  # characters; longer chunks are merged through a heap
LOCK_STEP = 16_384  # chunks of one length merged at a time
BLOCK_CHUNKS = 200_000  # chunks of one text looked up at a time
GROUP_CHARS = 2_000_000  # characters of the texts whose new chunks are merged together
NEVER = float("inf")
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
SYMBOLS = string.punctuation


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharMap:
    """Longest-prefix lookup in a compiled character map (empty: identity)."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at ``at`` and what replaces them."""
        found, node = None, self._offset(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[k]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        n, where = found
        return n, self.strings[where : self.strings.index(b"\0", where)]


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not spec.escape_whitespaces:
            raise ValueError("a BPE model with escaped white space is needed")
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kinds = [p.type for p in model.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.rank = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.pieces = len(model.pieces)
        self.decimal = [str(i) for i in range(self.pieces)]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk = kinds.index(2)
        self.end = model.trainer_spec.eos_id
        crossing = any(MARK in p.lstrip(MARK) for p in self.rank)
        follow = {p[k + 1] for p in self.rank for k in range(len(p) - 1) if LETTER.match(p[k])}
        closing = re.escape("".join(c for c in SYMBOLS if c not in follow))
        words = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        if closing:  # symbols that follow a letter in no piece
            words = f"{MARK}*{LETTER.pattern}++(?=[{closing}])|{words}"
        self.chunks = re.compile(".+" if crossing else words, re.DOTALL)
        self._pair_table()
        self.cache: dict[str, tuple[bytes, bytes, str]] = {}
        self.older: dict[str, tuple[bytes, bytes, str]] = {}

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The escaped text, and the source byte of each of its characters plus the
        end; ``None`` where a character map or squeezing is not involved (see ``align``)."""
        if not text:
            return "", [0]
        if not self.map.units and not self.squeeze:
            return (MARK if self.prefix else "") + text.replace(" ", MARK), None
        data, chars, source, at = text.encode(), [], [], 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = n, data[at : at + n]
            for c in hit[1].decode():
                chars.append(c)
                source.append(at)
            at += hit[0]
        if self.squeeze:
            keep = [k for k, c in enumerate(chars) if c != " " or (k and chars[k - 1] != " ")]
            while keep and chars[keep[-1]] == " ":
                keep.pop()
            end = source[keep[-1] + 1] if keep and keep[-1] + 1 < len(source) else len(data)
            chars, source = [chars[k] for k in keep], [source[k] for k in keep]
        else:
            end = len(data)
        if not chars:
            return "", [0]
        if self.prefix:
            chars, source = [" ", *chars], [source[0], *source]
        return "".join(chars).replace(" ", MARK), [*source, end]

    def align(self, text: str) -> np.ndarray:
        """Source bytes where only the prefix and the escape change the text."""
        if text.isascii():
            at = np.arange(len(text) + 1)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            at = np.zeros(len(code) + 1, np.int64)
            np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=at[1:])
        return np.concatenate([at[:1], at]) if self.prefix else at

    def _pair_table(self) -> None:
        """Numbers for what a part can be (pieces by their ids, further characters of
        pieces, one for any other character), and the pairs of parts that are pieces."""
        number = dict(self.rank)
        for c in sorted(set("".join(self.rank)) - number.keys()):
            number[c] = self.pieces + len(number) - len(self.rank)
        self.other = self.pieces + len(number) - len(self.rank)
        self.of_char = np.full(0x110000, self.other, np.int64)
        for part, i in number.items():
            if len(part) == 1:
                self.of_char[ord(part)] = i
        pairs = []
        for piece, cost in self.cost.items():
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((left * (self.other + 1) + right, cost, self.rank[piece]))
        pairs.sort()
        keys, costs, joined = zip(*pairs, strict=True) if pairs else ((), (), ())
        self.pair_keys = np.array([*keys, 1 << 62], np.int64)
        self.pair_costs = np.array([*costs, NEVER])
        self.pair_ids = np.array([*joined, 0], np.int64)

    def _look_up_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * (self.other + 1) + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_costs[at], NEVER), self.pair_ids[at]

    def merge_all(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes, str]]:
        """Of distinct chunks: ids, the number of characters of each (bytes of one
        character: all on the first, none on the rest), 32 bits each, and the decimal ids."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for chunk in chunks:
            by_length[len(chunk)].append(chunk)
        out = {}
        for length, group in by_length.items():
            if length > SHORT:
                out.update((chunk, self._entry(self._merge_long(chunk))) for chunk in group)
            else:
                for at in range(0, len(group), LOCK_STEP):
                    self._merge_together(group[at : at + LOCK_STEP], length, out)
        return out

    def _merge_together(self, group: list[str], length: int, out: dict) -> None:
        """Chunks of one length in lock step: each has its cheapest pair merged, leftmost
        first, in every round, and is done when no pair of it is a piece."""
        points = np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(-1, length)
        parts, sizes, names = self.of_char[points], np.ones(points.shape, np.uint32), np.arange(len(group))
        costs, joined = self._look_up_pairs(parts[:, :-1], parts[:, 1:])
        for width in range(length, 0, -1):
            if width > 1:
                k = costs.argmin(1)
                live = costs[np.arange(len(k)), k] < NEVER
            else:
                live = np.zeros(len(parts), bool)
            done = np.nonzero(~live)[0]
            known = (parts[done] < self.pieces).all(1).tolist()
            rows, lengths = parts[done], sizes[done]
            for name, row, ids, n, whole in zip(
                names[done].tolist(), rows.tolist(), rows.astype(np.uint32), lengths, known, strict=True
            ):
                chunk = group[name]
                if whole:
                    out[chunk] = ids.tobytes(), n.tobytes(), " ".join([self.decimal[i] for i in row])
                else:
                    ends = np.cumsum(n).tolist()
                    out[chunk] = self._entry([chunk[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            if not live.any():
                return
            names, parts, sizes, costs, joined, k = (x[live] for x in (names, parts, sizes, costs, joined, k))
            row = np.arange(len(k))
            parts[row, k] = joined[row, k]
            sizes[row, k] += sizes[row, k + 1]
            stays = np.ones(parts.shape, bool)
            stays[row, k + 1] = False
            parts, sizes = (x[stays].reshape(len(k), width - 1) for x in (parts, sizes))
            stays = np.ones(costs.shape, bool)
            stays[row, k] = False
            costs, joined = (x[stays].reshape(len(k), width - 2) for x in (costs, joined))
            for has, at in ((k < width - 2, k), (k > 0, k - 1)):  # pairs of the new part
                r, left = row[has], at[has]
                costs[r, left], joined[r, left] = self._look_up_pairs(parts[r, left], parts[r, left + 1])

    def _merge_short(self, chunk: str) -> list[str]:
        """Parts of one chunk, merged in lock step."""
        sizes = np.frombuffer(self.merge_all([chunk])[chunk][1], np.uint32)
        ends = np.cumsum(sizes[sizes > 0]).tolist()
        return [chunk[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _entry(self, parts: list[str]) -> tuple[bytes, bytes, str]:
        ids, lengths = [], []
        for part in parts:
            hit = self.rank.get(part)
            if hit is not None:
                ids.append(hit)
                lengths.append(len(part))
            elif self.bytes:
                raw = part.encode()
                ids += [self.bytes[b] for b in raw]
                lengths += [len(part)] + [0] * (len(raw) - 1)
            else:
                ids.append(self.unk)
                lengths.append(len(part))
        return np.array(ids, np.uint32).tobytes(), np.array(lengths, np.uint32).tobytes(), " ".join(map(str, ids))

    def _merge_long(self, chunk: str) -> list[str]:
        """The same for one chunk, through a heap of pairs."""
        n, cost = len(chunk), self.cost
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else n
            if left >= 0 and right < n:
                length = size[left] + size[right]
                hit = cost.get(chunk[left : left + length])
                if hit is not None:
                    heapq.heappush(heap, (hit, left, size[left], length))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, left, was, length = heapq.heappop(heap)
            right = after[left] if size[left] == was else n
            if right >= n or size[right] == 0 or size[left] + size[right] != length:
                continue
            size[left], size[right] = length, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        parts, at = [], 0
        while at < n:
            parts.append(chunk[at : at + size[at]])
            at += size[at]
        return parts

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, bytes, str]]:
        """Entries of chunks not in the cache, through the older generation; a full one
        replaces it."""
        if len(self.cache) >= CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        got = {chunk: entry for chunk in chunks if (entry := self.older.get(chunk))}
        got.update(self.merge_all([chunk for chunk in chunks if chunk not in got]))
        self.cache.update((chunk, entry) for chunk, entry in got.items() if len(chunk) <= CACHE_CHARS)
        return got

    def _look_up(self, chunks: list[str]) -> list[tuple[bytes, bytes, str]]:
        entries = list(map(self.cache.get, chunks))
        if None in entries:
            got = self.learn({chunk for chunk, entry in zip(chunks, entries, strict=True) if entry is None})
            entries = [entry or got[chunk] for chunk, entry in zip(chunks, entries, strict=True)]
        return entries

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
        """``encode`` of texts that are few or short, whose new chunks are merged together."""
        split = [self.chunks.findall(self.normalise(text)[0]) for text in texts]
        if len(split) > 1:
            self.learn({chunk for chunk in set().union(*split) - self.cache.keys() if len(chunk) <= CACHE_CHARS})
        for chunks in split:
            ids, lengths, decimals = [], [], []
            for at in range(0, len(chunks), BLOCK_CHUNKS):
                i, n, d = zip(*self._look_up(chunks[at : at + BLOCK_CHUNKS]), strict=True)
                ids.append(b"".join(i))
                lengths.append(b"".join(n))
                decimals += d
            numbers = (np.frombuffer(b"".join(x), np.uint32) for x in (ids, lengths))
            yield next(numbers).tolist(), decimals, next(numbers)

    def encode(self, text: str) -> tuple[list[int], list[str], np.ndarray]:
        """Ids without the end, their decimal forms by chunk, characters per id."""
        return next(self.encode_all([text]))

    def span_arrays(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte in the original text, and the byte after the last, of each id of
        ``encode``; the bytes of one character share its span."""
        source = self.normalise(text)[1] if self.map.units or self.squeeze else None
        source = self.align(text) if source is None else np.array(source)
        to = np.cumsum(lengths, dtype=np.int64)
        starts, ends = source[to - lengths], source[to]
        if not lengths.all():
            own = np.maximum.accumulate(np.where(lengths > 0, np.arange(len(lengths)), 0))  # the id whose span each has
            starts, ends = starts[own], ends[own]
        return starts, ends

    def spans(self, text: str, lengths: np.ndarray) -> list[tuple[int, int]]:
        """The same as pairs."""
        starts, ends = self.span_arrays(text, lengths)
        return list(zip(starts.tolist(), ends.tolist(), strict=True))

    def rows(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray, np.ndarray]]:
        """Of each text: ids with the end id, their decimal forms by chunk, first bytes and
        ends of their spans (the end id: empty, at the end)."""
        for text, (ids, decimals, lengths) in zip(texts, self.encode_all(texts), strict=True):
            starts, ends = self.span_arrays(text, lengths)
            size = len(text) if text.isascii() else len(text.encode())
            yield [*ids, self.end], [*decimals, str(self.end)], np.append(starts, size), np.append(ends, size)


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column (null: empty) with the row of the first: so many as have
    ``GROUP_CHARS`` characters together, or one longer text."""
    first, group, chars = 0, [], 0
    for row in range(len(column)):
        text = column[row].as_py() or ""
        if group and chars + len(text) > GROUP_CHARS:
            yield first, group
            first, group, chars = row, [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield first, group


def piece_codec(path: str) -> PieceCodec:
    """One for all tasks of a Python worker."""
    return once_per_worker(("piece_codec", path), lambda: PieceCodec(path))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec, library = piece_codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for _, group in _groups(b.column(1)):
                for ids, decimals, starts, ends in codec.rows(group):
                    spans = hashlib.sha256(np.stack([starts, ends], 1).astype("<u4").tobytes()).hexdigest()
                    out.append((len(ids), sha(" ".join(decimals)), sha(library.decode(ids)), spans))
            n, *digests = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path)
        ints = pa.list_(pa.int32())
        for b in batches:
            for first, group in _groups(b.column(1)):
                for row, (ids, _, starts, ends) in enumerate(codec.rows(group), first):
                    yield pa.RecordBatch.from_arrays(  # a batch per text bounds memory by the longest one
                        [
                            b.column(0).slice(row, 1),
                            pa.array([ids], ints),
                            pa.array([starts], ints),
                            pa.array([ends], ints),
                        ],
                        names=["doc_id", "ids", "starts", "ends"],
                    )

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, ids, starts, ends``: ids with the end id, and the byte span of each in
    the original UTF-8 text (the end id: empty, at the end).  Null text counts as
    empty: the end id alone.  Rows that repeat are encoded each; ids may be null."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_pieces(model or model_path()), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Of the rows of ``encode_documents``: number of ids, digests of the ids, of their
    decoded text and of the spans (first byte and end of each id, 32 bits each, least
    byte first); cases as above."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return slim.mapInArrow(_digests(model or model_path()), schema)


def piece_digests(docs: DataFrame, **options) -> DataFrame:
    """The same without the spans."""
    return encoding_digests(docs, **options).drop("spans_sha256")


def op10_piece_codec(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
