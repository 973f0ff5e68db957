r"""S1 for page documents of any size: one page is read by many tasks.

A page is a FeatureCollection.  It is read as pieces between opening braces
(``pieces.read_pieces``), so every piece but a file's first begins just inside an
object.  Quotes before a piece tell whether it starts within a string; brackets
outside of strings, summed up, tell its depth.  A feature begins with the brace that
opens at depth two (the page and its list) while the list is ``features``; the
pieces up to the next such brace are put together and parsed on their own.

What cannot be parsed stops the read, or goes to a quarantine table with its file,
its number in the page and the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakes.schema import FEATURE
from quakes.sources.pieces import last_before, read_pieces, sums_before
from quakes.sources.table import materialize

LIST_KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*$'  # a list begins where the piece ends
HAS_FEATURES = r'"features"\s*:\s*\['
CORRUPT = "_corrupt"
QUARANTINE = "file string, feature long, reason string, text string"


def _depth(text: Column, first_outside: int) -> Column:
    """Brackets opened less closed outside of strings; ``first_outside`` is 0 if the text
    starts outside of one, else 1.  The opening braces are the separators."""
    outside = F.array_join(F.filter(F.split(text, '"', -1), lambda _, k: k % 2 == first_outside), "")
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("["), F.lit("")))
    return opened - (F.length(outside) - F.length(F.translate(outside, "]}", "")))


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``depth`` (at their start, before their brace), ``opens`` (their brace
    is one outside of a string), ``ends`` (depth at their end), ``quoted_end``."""
    plain = F.regexp_replace("piece", r"\\.", "")  # no escaped quote counts
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    rows = pieces.select(
        "file", "block", "at", "piece",
        quotes.alias("quotes"), _depth(plain, 0).alias("net_outside"), _depth(plain, 1).alias("net_inside"),
    )
    rows = materialize(rows, "page_ranges")  # counted once; sums read the counts alone
    rows = sums_before(rows, quotes_before=F.col("quotes"), pieces_before=F.lit(1))
    quoted = F.col("quotes_before") % 2 == 1
    opens = ~quoted & (F.col("pieces_before") > 0)
    net = opens.cast("long") + F.when(quoted, F.col("net_inside")).otherwise(F.col("net_outside"))
    rows = rows.withColumns({"opens": opens, "net": net, "quoted_end": (F.col("quotes_before") + F.col("quotes")) % 2 == 1})
    return sums_before(rows, depth=F.col("net")).withColumn("ends", F.col("depth") + F.col("net"))


def feature_texts(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, feature, text`` of every feature (its text may run past its end), and
    ``file, reason`` of every page that is not whole."""
    rows = _placed(pieces)
    key = F.regexp_extract("piece", LIST_KEY, 1)
    begins = ~F.col("quoted_end") & (F.col("ends") == 2) & F.col("piece").rlike(LIST_KEY)
    rows = last_before(rows, "list", F.when(begins, key))
    listed = F.coalesce(F.col("list") == "features", F.lit(False))
    starts = F.col("opens") & (F.col("depth") == 2) & listed
    rows = sums_before(rows.withColumn("starts", starts), earlier=F.col("starts").cast("long"))
    rows = materialize(rows.withColumn("feature", F.col("earlier") + F.col("starts").cast("long")), "page_pieces")
    # a brace within a string opens nothing, but belongs to the feature it stands in
    within = F.col("starts") | ((F.col("depth") > 2) & listed)
    texts = (
        rows.where(within)
        .groupBy("file", "feature")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "piece"))).alias("parts"))
        .select("file", "feature", F.concat(F.lit("{"), F.array_join(F.transform("parts", lambda p: p["piece"]), "{")).alias("text"))
    )
    pages = rows.groupBy("file").agg(
        F.sum("net").alias("depth"), F.sum("quotes").alias("quotes"), F.bool_or(F.col("piece").rlike(HAS_FEATURES)).alias("listed"),
        F.min("ends").alias("least"), F.count("*").alias("n"),
    )
    reason = F.when((F.col("depth") != 0) | (F.col("quotes") % 2 == 1) | (F.col("least") < 0), "unbalanced page").when(
        ~F.col("listed"), "feed page without features"
    )
    return texts, pages.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def read_pages(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Page documents -> column ``f`` (one feature per row).

    Without ``quarantine`` a page that is cut short or has no features, or a feature
    that cannot be parsed, stops the read.  With it (a folder) such features and pages
    are appended there (``QUARANTINE``; read it back for their count), and what can be
    parsed is returned.  A feature's text is held by one task; a page's is not.  Strings
    may hold braces, brackets and escaped quotes; empty pages of features, and lists
    besides ``features``, are allowed.
    """
    pieces = read_pieces(spark, path, "{")
    texts, bad_pages = feature_texts(pieces)
    schema = T.StructType([*FEATURE.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = materialize(texts.withColumn("f", F.from_json("text", schema, options)), "page_features")
    bad = F.col("f").isNull() | F.col(f"f.{CORRUPT}").isNotNull()
    broken = parsed.where(bad).select("file", "feature", F.lit("unparsed feature").alias("reason"), "text")
    broken = broken.unionByName(bad_pages.select("file", F.lit(None).cast("long").alias("feature"), "reason", F.lit(None).cast("string").alias("text")))
    if quarantine is not None:
        broken.write.mode("append").parquet(quarantine)
    else:
        first = broken.limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['reason']}: {first[0]['file']}, feature {first[0]['feature']}")
    return parsed.where(~bad).select(F.struct(*(F.col(f"f.{c}").alias(c) for c in FEATURE.fieldNames())).alias("f"))


def write_pages(features: DataFrame, path: str) -> None:
    """Land features (column ``f``) as one page document per month of their time: a
    line per feature, streamed to the month's file."""
    month = F.coalesce(F.date_format(F.timestamp_millis("f.properties.time"), "yyyy-MM"), F.lit("none"))
    rows = features.where("f IS NOT NULL").select(month.alias("month"), F.col("f.id").alias("id"), F.to_json("f").alias("value"))
    # one shuffle puts a month in one task; its head and its end go with its first and its last feature
    of_month = Window.partitionBy("month").orderBy("id", "value")
    head = F.concat(F.lit('{"type":"FeatureCollection","metadata":{"title":"{events} of \\"'), F.col("month"), F.lit('\\"]","links":[{"rel":"self"}]},"features":[\n'))
    before = F.when(F.row_number().over(of_month) == 1, head).otherwise(",")
    end = F.when(F.lead(F.lit(1)).over(of_month).isNull(), '\n],"bbox":[-180,-90,180,90],"links":[{"rel":"next"}]}').otherwise("")
    lines = rows.select("month", "id", F.col("value").alias("feature"), F.concat(before, F.col("value"), end).alias("value"))
    ordered = lines.sortWithinPartitions("month", "id", "feature")
    ordered.select("month", "value").write.mode("overwrite").partitionBy("month").text(path)
