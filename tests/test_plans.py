"""Physical plans are the ones wanted."""

import pytest

from ledgerframe.engine import Engine
from ledgerframe.queries import CASES, catalog

from .oracle import SF


def plan(spark, name):
    case = CASES[name]
    return Engine(catalog(spark, SF, *case.tables)).explain(case.sql, case.parameters)


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_eq")
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text.split("ReadSchema")[1].splitlines()[0]
    assert "EqualTo(c_custkey,77)" in plan(spark, "key_lookup")


def test_pushdown_below_joins_and_partial_aggregates(spark):
    text = plan(spark, "join_multi")
    assert "EqualTo(o_orderstatus,O)" in text and "partial_sum" in text


def test_top_k_and_limits(spark):
    assert "TakeOrderedAndProject" in plan(spark, "order_multi_topk")
    assert "Scan parquet" not in plan(spark, "limit_zero")


def test_null_safe_join_has_equality_keys(spark):
    assert "coalesce(" in plan(spark, "join_null_keys")
