"""Plan properties that matter at scale."""

import pytest

from quakes.plans import catalog
from quakes.plans.pipeline import eq_table

from conftest import SF_SMALL

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "PythonMapInArrow", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def eq(spark):
    return eq_table(spark, SF_SMALL)


@pytest.mark.parametrize("q", [q for q in catalog.CATALOG if q.key != "q29"], ids=lambda q: q.key)
def test_catalog_queries_stay_in_the_jvm(eq, q):
    plan = _plan(q.fn(eq))
    assert not any(n in plan for n in PY_NODES)


def test_filter_and_columns_reach_the_scan(eq):
    plan = _plan(catalog.q30_deep_focus(eq))
    assert "PushedFilters: [IsNotNull(depth_km), GreaterThan(depth_km,300.0)]" in plan
    assert "ReadSchema: struct<depth_km:double,country:string>" in plan


def test_top_k_does_not_sort_globally(eq):
    plan = _plan(catalog.q1_strongest(eq))
    assert "TakeOrderedAndProject" in plan


def test_etl_map_back_is_a_broadcast_join(spark):
    from quakes.operators.clean import clean
    from quakes.plans.pipeline import enrich
    from quakes.sources.fixture import quake_raw

    df = enrich(clean(quake_raw(spark, SF_SMALL), rewrite=False), "plan-test")
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any(n in plan for n in PY_NODES)


def test_keywords_meet_texts_by_equality(spark):
    """D5 is a hash join on substrings; the nested loop left is the gazetteer's (249 rows)."""
    from quakes.operators.enrich import keyword_continent

    plan = _plan(keyword_continent(spark.createDataFrame([("Japan",)], "country string")))
    assert "BroadcastNestedLoopJoin" not in plan and "BroadcastHashJoin" in plan


def test_one_lookup_theta_join_is_left(spark):
    from quakes.operators.enrich import country_lookup
    from quakes.sources.fixture import quake_raw
    from quakes.operators.clean import clean_unfilled

    lk = country_lookup(clean_unfilled(quake_raw(spark, SF_SMALL), rewrite=False).select("country"))
    plan = _plan(lk)
    assert plan.count("BroadcastNestedLoopJoin") == 1


def test_pair_scan_never_moves_the_fact_rows_to_one_partition(eq):
    from quakes.operators.pairs import slice_candidates

    plan = _plan(slice_candidates(eq, 50.0, 3600.0))
    assert "rangepartitioning(t" in plan
    assert "SinglePartition" not in plan
    assert "Window" not in plan  # no global window over events
