"""Host-level quality rules (native).

Every document gets counts from its whole text and three rule outcomes.  Failures
are summed by host (``source``), each rule's rate is shrunk towards the rate of
all hosts by a beta prior fitted to the hosts by moments, and a host whose shrunk
rate of any rule reaches ``host_threshold`` is rejected with all its documents.
A small host with a few failures stays near the prior; only a host that nearly
always fails is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakes.llm.common import SPACE, SPACE_RUN, store, table, whole

RULES = ("base", "symbols", "dup_lines")
WINDOW_WORDS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _zip5(words: Column) -> Column:
    """Struct of five words for each window start."""
    n = F.greatest(F.size(words), F.lit(1))
    shifted = [words, *(F.slice(words, F.lit(k + 1), n) for k in range(1, WINDOW_WORDS))]
    return F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(F.size(words) - (WINDOW_WORDS - 1), F.lit(0)))


def _key(z: Column) -> Column:
    return F.xxhash64(z)


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``__q``: struct of the counts, from whole texts."""
    df = docs.withColumn("__t", whole(text_col))
    df = df.withColumn("__trim", F.btrim("__t", F.lit(SPACE)))
    empty = F.array().cast("array<string>")
    df = df.withColumn("__w", F.when(F.col("__trim") == "", empty).otherwise(F.split("__trim", SPACE_RUN)))
    df = df.withColumn("__z", _zip5(F.col("__w")))
    df = df.withColumn("__h", F.transform("__z", _key))
    # Only a text that repeats a window needs the sort below.
    none = F.col("__z").isNull()
    entry = F.transform("__z", lambda z, i: F.struct(_key(z).alias("h"), z.alias("z"), i.alias("i")))
    df = df.withColumn(
        "__s",
        F.when(none | (F.size(F.array_distinct("__h")) == F.size("__h")), F.slice(entry, 1, 0)).otherwise(F.sort_array(entry)),
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["z"] == y["z"]), F.lit(False))

    s = F.col("__s")
    df = df.withColumn(
        "__r",
        F.sort_array(
            F.filter(
                F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"])),
                lambda i: i.isNotNull(),
            )
        ),
    )
    r = F.col("__r")
    covered = F.aggregate(
        F.transform(r, lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(r, k + 1) - p, F.lit(WINDOW_WORDS)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    q = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    return df.withColumn("__q", q).drop("__t", "__trim", "__w", "__z", "__h", "__s", "__r", "__l")


def failures(q: str = "__q") -> dict[str, Column]:
    c = lambda name: F.col(f"{q}.{name}")
    return {
        "base": (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")),
        "symbols": 100 * c("n_symbols") > 50 * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
    }


def host_verdicts(judged: DataFrame, host: str, host_threshold: float = 0.9) -> DataFrame:
    """``(host, shrunk rates, host_failed)`` from ``__q``; null is a host of its own."""
    hosts = store(
        judged.groupBy(F.col(host).alias("host")).agg(
            F.count("*").alias("n"), *(F.sum(f.cast("long")).alias(f"k_{r}") for r, f in failures().items())
        ),
        "hosts",
    )
    # one row of moments over all hosts
    total = hosts.agg(
        *(F.expr(f"sum(k_{r}) / sum(n)").alias(f"m_{r}") for r in RULES),
        *(F.expr(f"var_pop(k_{r} / n)").alias(f"v_{r}") for r in RULES),
    ).first()
    out = hosts
    for r in RULES:
        m, v = total[f"m_{r}"] or 0.0, total[f"v_{r}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + m * strength) / (F.col("n") + strength))
    failed = F.greatest(*(F.col(f"rate_{r}") for r in RULES)) >= host_threshold
    return out.withColumn("host_failed", failed)


def judge(judged: DataFrame, host: str, host_threshold: float = 0.9) -> DataFrame:
    """Add ``__base_failed`` and ``__kept`` to rows that carry ``__q``."""
    bad = host_verdicts(judged, host, host_threshold).where("host_failed").select(F.col("host").alias("__host"))
    bad = store(bad, "bad_hosts")  # its real size decides whether Spark broadcasts it
    bad = bad.withColumn("__bad", F.lit(True))
    base = failures()["base"]
    return (
        judged.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
        .withColumn("__base_failed", base)
        .withColumn("__kept", ~base & F.col("__bad").isNull())
        .drop("__host", "__bad")
    )


def quality_rules(docs: DataFrame, host: str = "source", text_col: str = "text", host_threshold: float = 0.9) -> DataFrame:
    """``docs`` plus ``__q`` (counts), ``__base_failed`` and ``__kept``.

    Null or empty text: all counts zero, fails the word count.  Documents of a null
    host share one host.  Rows that repeat are judged alike, each counts.  An empty
    table gives an empty result.  Columns of ``docs`` pass through untouched.
    """
    return judge(store(signals(docs, text_col), "judged"), host, host_threshold)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    # counts are stored without the texts
    slim = signals(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return judge(store(slim, "judged"), "source").select(
        "doc_id",
        *(F.col(f"__q.{c}").alias(c) for c in COUNTS),
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


OP7_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT r, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
  FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words) WINDOW o AS (PARTITION BY r ORDER BY i)
), copies AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, x, x1, x2, x3, x4) AS copies FROM windows WHERE x4 IS NOT NULL
), repeats AS (
  SELECT r, sum(least(5, next - i)) AS n FROM (
    SELECT r, i, lead(i, 1, i + 5) OVER (PARTITION BY r ORDER BY i) AS next FROM copies WHERE copies > 1
  ) GROUP BY r
), counts AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
  FROM words LEFT JOIN repeats USING (r)
), rules AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * n_symbols > 50 * n_words AS symbols_failed, 100 * n_dup_lines > 50 * n_lines AS dup_lines_failed
  FROM counts
), hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k
  FROM (UNPIVOT (SELECT source, base_failed, symbols_failed, dup_lines_failed FROM rules)
        ON base_failed, symbols_failed, dup_lines_failed INTO NAME rule VALUE failed)
  GROUP BY source, rule
), moments AS (
  SELECT rule, sum(k) / sum(n) AS m, var_pop(k / n) AS v FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS strength FROM moments
), verdicts AS (
  SELECT source, max((k + m * strength) / (n + strength)) >= 0.9 AS host_failed FROM hosts JOIN priors USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR host_failed) AS kept
FROM rules JOIN verdicts ON rules.source IS NOT DISTINCT FROM verdicts.source
"""
