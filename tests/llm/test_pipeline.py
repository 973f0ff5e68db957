"""The pipeline against plain versions of its stages."""

import re
import statistics
import zlib
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quakes.llm import packing

from . import brute

SF = "/root/testdata/sf0.001"
MORE = (
    [re.compile(p) for p in ("AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "gh[pousr]_[A-Za-z0-9]{36,}", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")]
)


def rejected_hosts(rows, counts):
    fails = defaultdict(list)
    for (i, t, host), (_, n, _, symbols, dup, _, base) in zip(rows, counts, strict=True):
        lines = sum(bool(brute.words(x)) for x in (t or "").split("\n"))
        fails[host].append((base, 100 * symbols > 50 * n, 100 * dup > 50 * lines))
    bad = set()
    for rule in range(3):
        k = {h: sum(f[rule] for f in v) for h, v in fails.items()}
        mean = sum(k.values()) / sum(map(len, fails.values()))
        spread = statistics.pvariance([k[h] / len(v) for h, v in fails.items()])
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        bad |= {h for h, v in fails.items() if (k[h] + mean * strength) / (len(v) + strength) >= 0.9}
    return bad


def redacted(t):
    spans = [m.span() for m in brute.ASSIGN.finditer(t) if len(m[1]) >= 6] + [m.span() for p in MORE for m in p.finditer(t)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += t[at:a] + "[secret]"
        at = max(at, b)
    return out + t[at:]


def plain(rows):
    counts = brute.op7([(i, t) for i, t, _ in rows])
    bad = rejected_hosts(rows, counts)
    rows = [(i, t) for (i, t, h), c in zip(rows, counts, strict=True) if not c[-1] and h not in bad]
    rows = [r for r, v in zip(rows, brute.op3(rows), strict=True) if v[3]]
    rows = [r for r, v in zip(rows, brute.op1(rows), strict=True) if v[0] == v[2]]
    return [(i, redacted(t or "")) for i, t in rows]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    want = []
    for i, t in plain(rows):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = ids[at : at + 4096]
            want.append((i, k, at, len(p), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p))))
    out = corpus_pipeline.run(spark, SF).collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got) == sorted(want)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    rows = [(1, None, None), (1, None, None), (None, "a b c d e f g h i j k", "s"), (2, "", "s"), (3, "w " * 50000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit(1) for c in ("lang", "n_chars", "kept", "blob", "fp", "h", "uid", "host")}
    )
    out = stage(spark, docs, SF)
    assert out.count() >= 1
    if (name, stage) != corpus_pipeline.STAGES[-1]:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat, under one text or two, or are null."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (1, a), (7, c), (7, b), (9, b), (None, b), (None, d), (None, d), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    def left(name, docs):
        return sorted(((r["doc_id"], r["text"] or "") for r in stages[name](spark, docs, SF).collect()), key=repr)

    assert left("exact_dedup", docs) == sorted([(1, a), (7, c), (9, b), (None, d), (None, "")], key=repr)
    # near copies: white space and case do not count, and the least id names a group
    near = docs.union(docs.selectExpr("doc_id", "concat(upper(text), ' ')")).where("text is not null")
    got = left("simhash_dedup", near)
    assert sorted(((i, t.lower().strip()) for i, t in got), key=repr) == sorted([(1, a), (7, c), (7, b), (None, d), (None, "")], key=repr)


def test_a_stage_deletes_what_the_one_before_stored(spark):
    import os

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e f")], "doc_id long, text string")
    app = spark.sparkContext.applicationId
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["exact_dedup"](spark, docs, SF)
    assert kept.count() == 2
    first = list(corpus_pipeline._left[app])
    assert first and all(os.path.isdir(p.removeprefix("file://")) for p in first)
    stages["simhash_dedup"](spark, docs, SF)
    assert not any(os.path.isdir(p.removeprefix("file://")) for p in first)
