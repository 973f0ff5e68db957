"""The SQL text of each question equals its DataFrame form."""

import pytest

from quakes.plans import catalog
from quakes.plans.pipeline import eq_table
from quakes.plans.sql import SQL, run_sql

from conftest import SF_MID


def _rows(df):
    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def eq(spark):
    return eq_table(spark, SF_MID)


def test_every_question_but_the_pairs_has_sql():
    assert set(SQL) == {q.key for q in catalog.CATALOG} - {"q29"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_sql_equals_dataframe(spark, eq, key):
    sql_df = run_sql(spark, eq, key)
    api_df = catalog.BY_KEY[key].fn(eq)
    assert sql_df.columns == api_df.columns
    assert _rows(sql_df) == _rows(api_df)
