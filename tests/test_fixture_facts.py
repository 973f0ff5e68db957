"""Row counts recorded in FIXTURES.md for the quake view at sf0.01 (counted
before the LIMIT of the top-k questions)."""

import pytest
from pyspark.sql import functions as F

from quakes.operators.pairs import consecutive_pairs
from quakes.plans import catalog
from quakes.plans.pipeline import eq_table

from conftest import SF_MID

FINAL = {"q1": 11, "q2": 11, "q3": 3, "q4": 9, "q5": 4, "q9": 24, "q10": 5, "q11": 5, "q12": 9, "q13": 4, "q14": 2,
         "q15": 3, "q16": 3, "q17": 9, "q18": 143, "q19": 7, "q20": 5, "q21": 5, "q22": 735, "q23": 7, "q24": 3,
         "q25": 3, "q27": 1, "q28": 10, "q29": 82}
BEFORE_LIMIT = {"q6": ["year"], "q7": ["month", "year"], "q7_1": ["month"], "q8": ["day_of_week"], "q26": ["country"]}
BEFORE_LIMIT_COUNTS = {"q6": 7, "q7": 71, "q7_1": 12, "q8": 7, "q26": 25}


@pytest.fixture(scope="module")
def eq(spark):
    return eq_table(spark, SF_MID)


@pytest.mark.parametrize("key", sorted(FINAL))
def test_result_row_counts(eq, key):
    assert catalog.BY_KEY[key].fn(eq).count() == FINAL[key]


@pytest.mark.parametrize("key", sorted(BEFORE_LIMIT))
def test_group_counts_before_limit(eq, key):
    assert eq.select(*BEFORE_LIMIT[key]).distinct().count() == BEFORE_LIMIT_COUNTS[key]


def test_q30_groups_before_limit(eq):
    assert eq.where(F.col("depth_km") > 300).select("country").distinct().count() == 25


def test_pairs_across_hour_edges(eq):
    pairs = consecutive_pairs(eq)
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 3_600_000_000)
    assert pairs.where(hour("prev_time") != hour("time")).count() == 43


def test_view_covers_all_classes(eq):
    assert eq.select("continent").distinct().count() == 9
    assert eq.select("EQ_intensity").distinct().count() == 5
    assert eq.select("id").distinct().count() == eq.count() == 10000
