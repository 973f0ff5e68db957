"""The remembered words and chunks of op8 and op10 against the libraries on odd texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from quakes.llm import packing, piece_codec
from quakes.llm.common import portions
from quakes.llm.packing import TOKENIZER, WordEncoder, tokenizer_path
from quakes.llm.piece_codec import PieceCodec, model_path

PARTS = ["a", "B", "é", "é", "́", "Σ", "ß", "İ", "×", "٣", "日", "😀", "'s", "'", "<|endoftext|>", "<", "|", "&&", ",", ".", "12"]
PARTS += [" ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "the", "Tokens", "▁", "\x00"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(120))) for _ in range(600)]
    return [*odd, "", " ", "x" * 5000, "ab," * 900, "one two, two. ONE é,é"]


def test_word_encoder_equals_the_tokenizer(texts, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "BATCH_WORDS", 7)
    encoder = WordEncoder(tokenizer_path(TOKENIZER))
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == encoder.tok.encode(text, add_special_tokens=False).ids, text


def test_texts_are_encoded_together(texts, monkeypatch):
    """Words are looked up once for many texts, whatever is forgotten between them."""
    for name in ("CACHE_WORDS", "CACHE_UNITS"):
        monkeypatch.setattr(packing, name, 20)
    encoder = WordEncoder(tokenizer_path(TOKENIZER))
    full, asked = encoder._units, []
    monkeypatch.setattr(encoder, "_units", lambda units: asked.append(len(units)) or full(units))
    for size in (1, 50, len(texts)):
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            ids, ends = encoder.encode_all(pa.array(part))
            assert len(ends) == len(part) + 1
            for text, a, b in zip(part, ends, ends[1:], strict=False):
                assert ids[a:b].tolist() == encoder.tok.encode(text, add_special_tokens=False).ids, text
    before = len(asked)
    encoder.encode_all(pa.array([f"and x{k % 7} the" for k in range(900)]))
    assert len(asked) - before == 1  # one call for 900 texts
    assert [len(x) for x in encoder.encode_all(pa.array([], pa.string()))] == [0, 1]


def test_portions_are_bounded():
    texts = pa.array(["a", "b", "c", "d", "x" * 40, "e", "", "f" * 9, "g"])
    assert list(portions(texts, 3, 10)) == [(0, 3), (3, 4), (4, 5), (5, 8), (8, 9)]
    assert list(portions(pa.array([], pa.string()), 3, 10)) == []


def test_piece_codec_equals_the_library(texts, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_ENTRIES", 50)
    codec, library = PieceCodec(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    for text in texts:
        assert codec.encode(text)[0] == library.encode(text), text


def test_both_merges_agree(texts):
    codec = PieceCodec(model_path())
    for text in texts[:200]:
        for chunk in codec.chunks.findall(codec.normalise(text)[0]):
            assert codec._merge_short(chunk) == codec._merge_long(chunk)
