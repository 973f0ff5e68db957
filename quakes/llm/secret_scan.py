r"""Incremental secret scan over a blob ledger (native).

Every version of every file is addressed by the SHA-256 of its text.  The ledger
is a Parquet folder with a row per (blob, rule version) scanned so far, findings
or none.  A run scans only the pairs that the ledger lacks, each blob once however
many paths hold it, appends them, and joins findings back to all paths.

Spans are found with Spark's own regular-expression functions: ``split`` gives the
text between matches and ``regexp_extract_all`` the matches, whose lengths add up
to code-point offsets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import new_path, store, table, whole

#: kind, pattern, group whose length counts, least length.  The first three are the base.
#: [0-9a-f]{24,} and AKIA[A-Z0-9]{16,} find what the open patterns find and keep: a
#: shorter run holds no longer one.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,stop:int>>"
NO_SPANS = f"CAST(array() AS {SPAN})"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    p = F.lit(pattern)
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("g"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))
        good = F.coalesce(F.length(x["g"]) >= least, F.lit(False))
        return F.struct(stop.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(steps, first, step, lambda a: a["out"])).otherwise(F.expr(NO_SPANS))


def of_rank(rank: int):
    return lambda span: span["rank"] == rank


def scan(text: Column, rules=RULES) -> Column:
    """All spans of a text by start, then kind."""
    return F.array_sort(F.concat(*(_spans(text, i, *r[1:]) for i, r in enumerate(rules))))


def scan_blobs(versions: DataFrame, text_col: str = "text", ledger: str | None = None, rules=RULES) -> DataFrame:
    """Scan what ``ledger`` (a folder; a new one if none) lacks and return the ledger's
    rows for this rule version: ``blob, rule_version, spans``."""
    spark, version = versions.sparkSession, rule_version(rules)
    t = whole(text_col)
    blobs = versions.select(F.sha2(t, 256).alias("blob"), t.alias("text")).distinct()
    if ledger is None:
        ledger = new_path(spark, "ledger")
    else:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            done = spark.read.parquet(ledger).where(F.col("rule_version") == version).select("blob").distinct()
            blobs = blobs.join(done, "blob", "left_anti")
    blobs.select("blob", F.lit(version).alias("rule_version"), scan(F.col("text"), rules).alias("spans")).write.mode(
        "append"
    ).parquet(ledger)
    schema = f"blob string, rule_version string, spans {SPAN}"
    return spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == version)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """``doc_id, blob, spans`` for every row of ``docs`` (null text: empty, no spans).
    Rows that repeat are each returned; an empty table gives an empty result."""
    paths = store(docs.select(F.col(id_col).alias("doc_id"), F.sha2(whole(text_col), 256).alias("blob")), "paths")
    seen = scan_blobs(docs, text_col, ledger)
    hits = store(seen.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), "findings")
    return paths.join(hits, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.expr(NO_SPANS)).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) replaced by ``[secret]``;
    all other columns and rows stay."""
    seen = scan_blobs(docs, text_col, ledger)
    hits = store(
        seen.where(F.size("spans") > 0).select(F.col("blob").alias("__b"), F.col("spans").alias("__s")).dropDuplicates(["__b"]),
        "findings",
    )
    df = docs.withColumn("__blob", F.sha2(whole(text_col), 256)).join(hits, F.col("__blob") == F.col("__b"), "left")
    text = F.col(text_col)

    def cut(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[secret]")))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.concat(acc["out"], F.coalesce(gap, F.lit(""))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("__s", start, cut, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.col("__s").isNull(), text).otherwise(clean)).select(*docs.columns)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(r[0]) for r in RULES))

    def text(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
            ),
            ",",
        )

    spans = F.col("spans")
    # a function of one argument each: a second one would be the element's index
    counts = [F.size(F.filter(spans, of_rank(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))
