"""Corpus pipeline: quality rules, exact dedup, near dedup, secrets, packing.

Every stage works on the table its predecessor wrote; all but the last return the
columns of ``documents``.  The dedup stages number the rows they are given and drop
row by row, so one row of each group stays even where ids repeat or are null.

What a stage stores on its way is needed until its result has been written.  Each
stage is given a written table, so it begins by deleting what the one before it stored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakes.llm.common import remove, scratch, store, table
from quakes.llm.exact_dedup import drop_copies
from quakes.llm.packing import pack_documents
from quakes.llm.quality_rules import quality_rules
from quakes.llm.secret_scan import redact
from quakes.llm.simhash_dedup import drop_near_copies

#: A stage of the SQL cannot express (XXH64 fingerprints, tokenizers): tested by brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage of an application stored on its way.
_left: dict[str, list[str]] = {}


def stage(function: Stage) -> Stage:
    """Deletes what the stage before stored on its way, and remembers what this one does."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        remove(spark, _left.pop(app, []))
        with scratch() as paths:
            out = function(spark, docs, sf_dir)
        _left[app] = paths
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality_rules(docs).where("__kept").select(*docs.columns)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row of the largest id stays."""
    return drop_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row of the least id stays."""
    return drop_near_copies(docs)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced; ``n_chars`` follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input goes once its result is written.
    An empty table gives an empty result."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        with scratch() as written:
            docs = store(out, name)
        remove(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
