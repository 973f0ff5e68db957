"""Language model, page text, ZIP archives and piece codec."""

import hashlib
import html as html_lib
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quakes.llm import common, page_text, piece_codec, pitman_yor, zip_archives

from quakes.session import path_exists

from .brute import words

SF = "/root/testdata/sf0.001"


def tokens(t):
    return [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]


def test_op2_base_columns_and_held_out_gain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    rows += [(9001, None), (9002, ""), (9003, "Never seen wörds"), (None, "a null id"), (9004, "twice"), (9004, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "u": F.lit(2), "held_out": F.lit(3)})
    got = pitman_yor.lm_scores(df).collect()
    c = Counter(w for i, t in rows if not out_of(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), out_of(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5))
        for i, t in rows
    )
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert have == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one_and_scores_follow_them(spark):
    texts = ["a b a b c", "a b d", "b a c a b", "d d d a"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    m = pitman_yor.train(df)
    seen = {(r["u"], r["w"]): r["p"] for r in m.seen.collect()}
    backs = {r["u"]: [r[f"back_{s}"] for s in range(2)] for r in m.contexts.collect()}
    p1 = {r["w"]: [r[f"p1_{s}"] for s in range(2)] for r in m.words.collect()}

    def prob(u, w):
        parts = zip(backs.get(u, [1.0] * 2), p1.get(w, m.unknown), strict=True)
        return seen.get((u, w), sum(x * y for x, y in parts) / 2)

    for u in backs:
        assert sum(prob(u, w) for w in [*p1, 0]) == pytest.approx(1)
    new = [(0, "a b x d"), (1, ""), (2, "x x")]
    got = {r["row"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(new, "row long, text string"), m).collect()}
    for row, text in new:
        ids = pitman_yor.token_ids(text)
        pairs = zip([pitman_yor.word_id(pitman_yor.END), *ids], ids, strict=False)
        assert got[row] == pytest.approx(sum(math.log10(prob(u, w)) for u, w in pairs))


def test_seating_follows_the_restaurant():
    """Mean number of tables against customers seated one by one."""
    rng, weight, d = np.random.default_rng(3), 1.7, 0.6
    fast = pitman_yor.seat(np.full(4000, 40), np.full(4000, weight), d, np.arange(4000, dtype=np.uint64) * np.uint64(977))
    plain = []
    for _ in range(4000):
        t = 1
        for i in range(1, 40):
            t += rng.random() < weight / (weight + i - d * t)
        plain.append(t)
    assert fast.mean() == pytest.approx(np.mean(plain), rel=0.03) and fast.std() == pytest.approx(np.std(plain), rel=0.08)
    assert list(pitman_yor.seat(np.array([0, 1, 2]), np.array([1e-12, 1.0, 1e12]), d, np.arange(3, dtype=np.uint64))) == [0, 1, 2]


def test_a_dish_is_seated_alike_among_any_others():
    rng = np.random.default_rng(4)
    c, a, keys = rng.integers(1, 60, 500), rng.random(500) * 3, rng.integers(0, 1 << 63, 500).astype(np.uint64)
    whole = pitman_yor.seat(c, a, 0.75, keys)
    order = rng.permutation(500)
    parts = np.concatenate([pitman_yor.seat(c[k], a[k], 0.75, keys[k]) for k in np.array_split(order, 7)])
    assert (parts == whole[order]).all() and len(set(whole[c > 20])) > 3


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = []
    for n in (3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append({r["doc_id"]: r["score"] for r in pitman_yor.lm_scores(docs.repartition(n)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got[0].keys() == got[1].keys()
    assert all(got[1][k] == pytest.approx(v, rel=1e-9) for k, v in got[0].items())


def test_op2_counts_pairs_of_odd_texts(monkeypatch):
    rng = random.Random(6)
    parts = ["a", "A", "b", " ", " ", "\n", "\t", "\x85", "\xa0", "\x1c", "À", "à", "日", "'", "zz"]
    texts = [None, "", " ", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)), "b " * 900]
    rows = list(range(5, 5 + len(texts)))
    batch = pa.record_batch({"row": pa.array(rows), "text": pa.array(texts)})
    start, want = pitman_yor.word_id(pitman_yor.END), Counter()
    for row, text in zip(rows, texts, strict=True):
        ids = pitman_yor.token_ids(text)
        want.update((row, u, w) for u, w in zip([start, *ids], ids, strict=False))
    for docs, size in ((7, 1 << 20), (4096, 40), (4096, 1 << 20)):
        monkeypatch.setattr(pitman_yor, "CHUNK_DOCS", docs)
        monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", size)
        got = [r for b in pitman_yor._bigrams(True)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
        assert len(got) == len(want) and Counter({(r["row"], r["u"], r["w"]): r["n"] for r in got}) == want
        both = Counter()
        for b in pitman_yor._bigrams(False)(iter([batch])):
            for r in b.to_pylist():
                both[r["u"], r["w"]] += r["n"]
        assert both == sum((Counter({(u, w): n}) for (_, u, w), n in want.items()), Counter())


def test_op2_keeps_no_table_that_the_model_does_not_need(spark):
    key = common.DROP_SHUFFLES
    before = spark.conf.get(key, "false")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("row"), "text")
    with common.scratch() as made:
        m = pitman_yor.train(docs)
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made if path_exists(spark, p)) == ["context_model", "seen", "word_model"]
    assert spark.conf.get(key, "false") == before
    with common.scratch() as made:
        pitman_yor.score(docs, m).collect()
    assert len(made) == 1  # pairs of texts are not stored before they meet the model


def test_op2_stores_pairs_in_few_bytes_and_no_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    with common.scratch() as made:
        pitman_yor.lm_scores(docs)
    kept = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: p for p in made if path_exists(spark, p)}
    assert sorted(kept) == ["context_model", "scores", "seen", "word_model"]
    train = docs.where(~pitman_yor.held_out()).select(F.lit(None).cast("long").alias("row"), "text")
    pairs = train.mapInArrow(pitman_yor._bigrams(False), "u long, w long, n int").select("u", "w").distinct().count()
    path = spark._jvm.org.apache.hadoop.fs.Path(kept["seen"])
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    assert size < 8 * pairs  # two words alone have 16 bytes


def test_op2_blocks_give_their_pairs_back():
    rng = np.random.default_rng(12)
    top = (1 << 31) - 1
    for pairs in (
        np.empty(0, np.int64),
        np.array([0]),
        np.array([5, 6, top << 32, top << 32 | top]),
        np.unique(rng.integers(0, 40, 3000) << 32 | rng.integers(0, 90, 3000)),
        np.unique(rng.integers(0, top, 3000) << 32 | rng.integers(0, top, 3000)),
    ):
        assert (pitman_yor._unpack_pairs(pitman_yor._pack_pairs(pairs)) == pairs).all()
        order, at = pitman_yor._by_bucket(pairs, 7)
        assert at[-1] == len(pairs) and sorted(order) == list(range(len(pairs)))
        assert all((np.diff(pairs[order[i:j]]) > 0).all() for i, j in zip(at[:-1], at[1:], strict=True))


def test_op2_scores_do_not_depend_on_rounds_and_chunks(spark, monkeypatch):
    texts = ["a b a b c", "a b d", "a b d", "b a c a b", "d d d a", None, " x  y ", "", "A B"] * 3
    docs = spark.createDataFrame([(i // 2 if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = []
    for rounds, size in ((1, 1 << 20), (3, 12)):
        for name, value in (("TRAIN_ROUNDS", rounds), ("SCORE_ROUNDS", rounds), ("CODED_BYTES", size)):
            monkeypatch.setattr(pitman_yor, name, value)
        rows = pitman_yor.lm_scores(docs).collect()
        got.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows))
    assert got[0] == got[1] and len(got[0]) == len(texts)


def test_dishes_are_seated_alike_in_frames_of_any_size(monkeypatch):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"u": rng.integers(0, 9, 400), "w": np.arange(400), "c": rng.integers(1, 50, 400), "open": rng.random(400) * 4})
    parts = [frame[k : k + 30] for k in range(0, 400, 30)]
    got = []
    for size in (1, 100, 1000):
        monkeypatch.setattr(pitman_yor, "SEAT_ROWS", size)
        out = list(pitman_yor._seat_rows(0.75, 5)(iter(parts)))
        got.append((len(out), pd.concat(out, ignore_index=True)))
    assert [n for n, _ in got] == [14, 4, 1]
    assert got[0][1].equals(got[1][1]) and got[0][1].equals(got[2][1])


def test_op2_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pitman_yor.lm_scores(none).count() == 0


def article(page):
    """Plain reading of the generated pages: the blocks inside the article."""
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)
    parts = re.split(r"</?(?:h1|p)>", found[1]) if found else []
    parts = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x))).strip() for x in parts]
    return "\n".join(p for p in parts if p)


def test_op5(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r["page_id"]: r for r in page_text.op5_page_text(spark, SF).collect()}
    assert len(got) == len(pages)
    right = sum(got[p["page_id"]]["text"] == article(p["html"]) for p in pages)
    assert right >= 0.97 * len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_held_out_blocks(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    model = page_text.train(pages[:120])
    right = total = 0
    for p in pages[120:]:
        blocks = page_text.blocks_of(p)
        keep = page_text.predict_pages(model, [blocks])[0] >= 0.5
        right += int((keep == (page_text.declared(blocks) > 0.5)).sum())
        total += len(blocks)
    assert right / total > 0.99


def test_whole_pages_outside_the_sample(spark, monkeypatch):
    taught, train = [], page_text.train
    monkeypatch.setattr(page_text, "train", lambda pages: taught.extend(pages) or train(pages))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages, train_pages=100).collect()}
    new = [p for p in pages.collect() if p["html"] not in set(taught)]
    assert len(taught) == 100 and len(new) >= 100
    assert sum(got[p["page_id"]] == article(p["html"]) for p in new) >= 0.97 * len(new)


def test_sample_is_of_distinct_pages(spark, monkeypatch):
    monkeypatch.setattr(page_text, "train", lambda pages: pages)
    html = [f"<article><p>page {k}" for k in range(6)]
    df = spark.createDataFrame([(1, "u", h) for h in [*html, *html * 40]], "page_id long, url string, html string")
    assert sorted(page_text.fit(df, train_pages=20)) == html
    assert len(set(page_text.fit(df, train_pages=4))) == 4


def test_nothing_to_train_on(spark):
    rows = [(1, "u", "<article><p>" + "long " * 50), (2, "u", "<p></p>"), (3, "u", ""), (4, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with pytest.raises(ValueError, match="no page to train on"):
        page_text.fit(df, train_chars=100)
    assert [r["text"] for r in page_text.extract(df.where("page_id > 1")).collect()] == [""] * 3


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(0)
    m, x, y = page_text.new_model(), rng.normal(size=(5, page_text.PATH_DIM + page_text.WORD_DIM + 3)), np.array([1.0, 0, 0, 1, 1])
    g = page_text.gradient(m, x, y)

    def loss():
        p = page_text.predict(m, x)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, v in m.items():
        at = tuple(rng.integers(n) for n in v.shape)
        keep = v[at]
        v[at] = keep + 1e-5
        up = loss()
        v[at] = keep - 1e-5
        assert g[k][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        v[at] = keep


def test_blocks_of_broken_pages():
    b = page_text.blocks_of("<p>a<p>b &amp; <b>c</b>\n d<br>e<script>x</p></script><ul><li>one<li>two</ul>tail")
    assert [t for _, t in b] == ["a", "b & c d e", "one", "two", "tail"]
    assert page_text.blocks_of(None) == [] and page_text.blocks_of("<<<>") is not None


LEFT_OPEN = [
    "<html><head><title>T</title><body><article><p>text",
    "<html><head><title>T</title><article><p>text</article>",
    "<head><meta charset=x><link rel=y><style>s</style>text",
    "<head><noscript><p>no script</noscript><title>T</title><body><p>text",
    "<head><title>T<body><article><p>text",
    "<body><div><select><option>a<option>b<p>text</p></div>",
    "<body><select><option>a<div>text</div>",
    "<body><button>B<p>text",
    "<body><button>B<p>text</p><button>C<i>D</i></button>",
    "<body><svg><title>t</title><text>u</text><path d=x><p>text",
    "<body><div><iframe src=x>none<section>text</section></div>",
    "<body><noscript>no script<main><p>text</main>",
    "<body><noscript><svg><p>gone</svg><p>text",
]
CLOSED = [
    "<head><noscript><p>no script</p></noscript></head><p>text",
    "<p>text</p><button><div>B</div><p>C</button><select><option><p>a</select><noscript><div>n</div></noscript>",
    "<object><p>o<svg><p>s</object><p>text<template><div>u<template><p>v</template>w</template>",
]


@pytest.mark.parametrize("html", LEFT_OPEN + CLOSED)
def test_blocks_after_silent_elements(html):
    assert [t for _, t in page_text.blocks_of(html)] == ["text"]


def test_left_out_head_end_changes_nothing():
    pages = [page_text.blocks_of(f"<html><head><title>T</title>{end}<body class=b><article><p>one<p>two") for end in ("", "</head>")]
    assert pages[0] == pages[1] and len(pages[0]) == 2


def test_pages_with_gaps(spark):
    rows = [(1, None, None), (1, None, ""), (None, "u", "<article><p>x"), (2, "u", "<p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert page_text.extract(df).count() == 4
    assert page_text.extract(df.limit(0)).count() == 0


def test_op6(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(900, "u\r\nX: y é%", "é same"), (901, None, "é same"), (902, "v", "é same"), (903, None, None), (904, "w", ""), (None, "n", "é same")]
    rows += [(905, "x", "PK\x05\x06 WARC/1.1\r\n\r\n"), (None, "n", "only null")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "head": F.lit(2)})
    folder, manifest = zip_archives.archive_pages(df.repartition(3), archive_bytes=20_000)
    got = sorted((tuple(r) for r in zip_archives.read_archives(folder, manifest, True).collect()), key=repr)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max((x for x in (top.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, u, h in rows:
        data, head = (h or "").encode(), top[h or ""]
        first = i == head
        want.append((i, u, len(data), zip_archives.base32_sha1(data), "response" if first else "revisit", None if first else head, bytearray(data) if first else None))
    assert got == sorted(want, key=repr)
    assert manifest.count() > 3
    with zipfile.ZipFile(f"{folder.removeprefix('file://')}/{manifest.first()['name']}") as z:
        assert z.testzip() is None and z.namelist() == [zip_archives.DATA, zip_archives.INDEX]
    small = zip_archives.archive_pages(df, least_bytes=10_000_000)
    assert {r["record_type"] for r in zip_archives.read_archives(*small).collect()} == {"response"}
    none = zip_archives.archive_pages(df.limit(0))
    assert zip_archives.read_archives(*none).count() == 0


def test_zip64_directory(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(66_000):  # more than the plain directory can count
            z.writestr(f"m{k}", b"" if k % 5000 else b"data%d" % k)
    with open(path, "rb") as f:
        z = zip_archives.ZipReader(f, path.stat().st_size)
        assert len(z.members) == 66_000
        start, size = z.locate("m65000")
        assert z.range(start, 0, size) == b"data65000"
    with open(path, "rb") as f, pytest.raises(ValueError):
        zip_archives.ZipReader(f, 1000)


TEXTS = ["", " ", "  a  b ", "▁x ▁▁", "<s></s><0x41>", "\x00a\x00", "é 😀😀 한국어 \t\n\r\n", "a" * 5000, "ab" * 4000, " " * 60]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


def test_op10(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(2000, None), (None, "x"), (2001, "x"), (2001, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit(1)})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = [*library.encode(t or ""), 2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, piece_codec.piece_digests(df).collect()), key=repr) == sorted(want, key=repr)
    spans = {r["doc_id"]: r for r in piece_codec.encode_documents(df).collect()}
    for k, t in enumerate(TEXTS):
        r, data = spans[1000 + k], t.encode()
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        cuts = sorted({(a, b) for a, b in zip(r["starts"], r["ends"], strict=True) if b > a})
        assert b"".join(data[a:b] for a, b in cuts) == data
    assert piece_codec.piece_digests(df.limit(0)).count() == 0


def test_op10_digests_the_spans(spark, library, tmp_path):
    """Each piece's bytes in the original text, found by a plain walk over the library's pieces."""
    texts = [*TEXTS, "é日😀 naïve\x01 text\n", "ab cé😀▁\n<>01the  "]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(20).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans_sha256"] for r in piece_codec.op10_piece_codec(spark, str(tmp_path)).collect()}
    full = {r["doc_id"]: list(zip(r["starts"], r["ends"], strict=True)) for r in piece_codec.encode_documents(df).collect()}
    for k, t in enumerate(texts):
        want, at, rest, prefix = [], 0, 0, bool(t)
        for piece in library.encode(t, out_type=str):
            if re.fullmatch("<0x[0-9A-F]{2}>", piece) and not t[at : at + 6] == piece:
                if not rest:
                    rest = len(t[at].encode())
                    want.append((len(t[:at].encode()), len(t[: at + 1].encode())))
                    at += 1
                else:
                    want.append(want[-1])
                rest -= 1
                continue
            n = len(piece) - prefix
            prefix = False
            assert t[at : at + n].replace(" ", "▁") == piece[len(piece) - n :]
            want.append((len(t[:at].encode()), len(t[: at + n].encode())))
            at += n
        want.append((len(t.encode()),) * 2)
        assert full[k] == want
        data = b"".join(x.to_bytes(4, "little") for s in want for x in s)
        assert got[k] == hashlib.sha256(data).hexdigest()


def test_random_texts_equal_the_library(library):
    rng, codec = random.Random(2), piece_codec.PieceCodec(piece_codec.model_path())
    for _ in range(2000):
        t = "".join(rng.choice("ab cé😀▁\n<>01the  ") for _ in range(rng.randrange(60)))
        ids, _, lengths = codec.encode(t)
        assert ids == library.encode(t)
        assert len(codec.spans(t, lengths)) == len(ids)


def test_longest_prefix_of_a_character_map():
    """A double array made by hand for the keys "a" -> "x" and "ab" -> "yz"."""
    units = [0] * 1024
    units[0] = 256 << 10  # children of the root at 256 ^ byte
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | ((a ^ 512) << 10)  # its children at 512 ^ byte
    units[512] = 1 << 31 | 0
    b = 512 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | ((b ^ 590) << 10)
    units[590] = 1 << 31 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0yz\0"
    m = piece_codec.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"b", 0) is None
    codec = piece_codec.PieceCodec(piece_codec.model_path())
    codec.map = m
    assert codec.normalise("cab a") == ("▁cyz▁x", [0, 0, 1, 1, 3, 4, 5])


def test_pages_in_lock_step_and_in_pieces_read_the_same(spark, monkeypatch):
    pages = [page_text.blocks_of(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    pages = [[], *pages, pages[0] * 40, []]
    model = page_text.new_model(3)
    want = [page_text.predict(model, page_text.features(b)) if b else np.zeros(0) for b in pages]
    for group in (10**6, 100, 7):
        monkeypatch.setattr(page_text, "GROUP_BLOCKS", group)
        got = page_text.predict_pages(model, pages)
        assert all(np.allclose(g, w, atol=1e-12) for g, w in zip(got, want, strict=True))
    assert page_text.predict_pages(model, []) == []


def test_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(zip_archives, "RANGE", 5)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").repartition(4)
    folder, manifest = zip_archives.archive_pages(pages, archive_bytes=50_000)
    out = zip_archives.read_archives(folder, manifest)
    tasks = {r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}
    assert manifest.count() > 3 and len(tasks) > 3
    assert sorted(r["page_id"] for r in out.collect()) == sorted(r["page_id"] for r in pages.collect())
