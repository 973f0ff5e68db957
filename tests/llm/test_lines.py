"""Line dedup against a plain version, its SQL and awkward rows."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quakes.llm import line_dedup
from quakes.llm.queries import oracle_sql

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
A, B, C = "A line of twenty chars and more", "another line that many texts hold", "É line with letters beyond ASCII İ"
AWKWARD = [
    (1, f"{A}\n{B}\nshort"), (2, f" {A.lower()}\t\nown text of document two\n{A}"), (3, f"{A}\r\n\n{B}"),
    (4, None), (5, ""), (6, "\n\n"), (7, "short\nshort"), (8, B + "\n" + B), (9, C), (10, C.replace("line", "LINE")), (11, C),
    (12, C.replace("İ", "i̇")), (None, A), (None, B + "x"), (13, A), (13, A), (13, f"{A}\nmore"), (14, "x" * 19), (15, "x" * 19),
    (16, "x" * 19), (17, "x" * 20), (18, "x" * 20), (19, "X" * 20 + "\x0b"), (20, f"{A}\n" * 3000), (21, "\x85" + "y" * 20),
]


def plain(rows):
    """Documents are (id, text); the last of a line's documents is the largest."""
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(SPACE))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add((i, t or ""))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            docs = held.get(key(line), ())
            ids = {d for d, _ in docs}
            top = max(d if d is not None else -1 for d in ids) if ids else None
            kept.append(len(docs) < 3 or i == top)
        text = "\n".join(x for x, k in zip(lines, kept, strict=True) if k)
        out.append((i, len(lines), kept.count(False), hashlib.sha256(text.encode()).hexdigest(), text))
    return out


def frame(spark, rows):
    """Columns that clash with names used inside the operator."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df.withColumns({c: F.lit(7) for c in ("text_key", "keep", "gone", "slice", "h", "entries", "kept_id")})


def digests(spark, df):
    bitmaps = line_dedup.line_bitmaps(df)
    texts = line_dedup.keep_lines(df, bitmaps)
    assert texts.columns == df.columns
    counts = sorted(map(repr, (tuple(r) for r in bitmaps.select("doc_id", "n_lines", "n_dropped").collect())))
    kept = sorted(map(repr, (tuple(r) for r in texts.select("doc_id", F.coalesce("text", F.lit(""))).collect())))
    return counts, kept


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_awkward_rows(spark, partitions):
    rows = [r for r in AWKWARD if r[0] != 13]  # an id with two texts is told apart by a hash, see below
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        counts, kept = digests(spark, frame(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = plain(rows)
    assert counts == sorted(repr(w[:3]) for w in want)
    assert kept == sorted(repr((w[0], w[4])) for w in want)


def test_an_id_with_several_texts_keeps_the_line_in_one(spark):
    rows = [(13, A), (13, A), (13, f"{A}\nmore"), (12, A), (1, A)]
    bitmaps = line_dedup.line_bitmaps(frame(spark, rows)).collect()
    kept = {(r["doc_id"], r["text_key"]) for r in bitmaps if any(k["start"] == 0 for k in r["keep"])}
    assert len(bitmaps) == 5 and len(kept) == 1 and next(iter(kept))[0] == 13


def test_a_line_of_all_documents_over_many_slices(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        rows = [(i, f"{A}\nown line number {i} of this document\n{B if i % 3 else i}") for i in range(400)]
        counts, kept = digests(spark, frame(spark, rows))
        plan = line_dedup._dropped(
            line_dedup._documents(frame(spark, rows), "doc_id", "text", 20)
            .select("doc_id", "text_key", F.explode("entries").alias("e"))
            .select("doc_id", "text_key", "e.*")
        )._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = plain(rows)
    assert counts == sorted(repr(w[:3]) for w in want)
    assert kept == sorted(repr((w[0], w[4])) for w in want)
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_range_partitioning_serves_the_grouping(spark):
    """One range shuffle and one by slice; none by hash alone."""
    docs = line_dedup._documents(frame(spark, AWKWARD), "doc_id", "text", 20)
    entries = docs.select("doc_id", "text_key", F.explode("entries").alias("e")).select("doc_id", "text_key", "e.*")
    held = entries.repartitionByRange("h", "g", F.col("doc_id").desc_nulls_last(), "text_key")
    held = held.groupBy("h", "g", "doc_id", "text_key").agg(F.collect_set("pos"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_empty(spark):
    assert line_dedup.line_bitmaps(frame(spark, [])).count() == 0


def test_query_equals_sql_and_plain(spark):
    got = line_dedup.op11_line_dedup(spark, SF)
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(oracle_sql()["op11_line_dedup"])
    assert sorted(sql.columns) == sorted(got.columns)
    assert rows == sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({oracle_sql()['op11_line_dedup']})").fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows == sorted(w[:4] for w in plain(docs))
    assert any(r[2] for r in rows)
