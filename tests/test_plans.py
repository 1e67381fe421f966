"""Plans: what reaches the scan, which join and aggregate is chosen."""

import pytest
from pyspark.sql import functions as F

from cairn.plans import catalogue
from cairn.sources import catalog


def plan(df, adaptive=False):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def orders(spark, tiny):
    return catalog.scan(spark, tiny, "orders")


def test_filters_and_columns_reach_the_scan(spark, tiny):
    text = plan(catalogue.queries()["flagship"](spark, tiny))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_aggregates_are_partial_first(spark, tiny):
    text = plan(catalogue.queries()["flagship"](spark, tiny))
    assert "partial_sum" in text and "HashAggregate" in text


def test_string_minimum_sorts(orders):
    assert "SortAggregate" in plan(orders.groupBy("o_custkey").agg(F.min("o_orderpriority")))


@pytest.mark.parametrize("hint,node", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")])
def test_join_kinds(orders, spark, tiny, hint, node):
    customers = catalog.scan(spark, tiny, "customer")
    assert node in plan(orders.join(customers.hint(hint), F.col("o_custkey") == F.col("c_custkey")))


def test_theta_join_is_a_nested_loop(spark, tiny):
    assert "BroadcastNestedLoopJoin" in plan(catalogue.queries()["join_theta"](spark, tiny))


def test_top_k_needs_no_full_sort(spark, tiny):
    assert "TakeOrderedAndProject" in plan(catalogue.queries()["topk"](spark, tiny))


def test_no_python_in_engine_plans(spark, tiny):
    for name, f in catalogue.queries().items():
        text = plan(f(spark, tiny))
        assert not any(x in text for x in ("Python", "Pandas", "InArrow")), name


def test_constants_fold_and_joins_come_from_where(spark, orders, tiny):
    assert "(3 + 4)" not in plan(orders.where(F.col("o_orderkey") == F.lit(3) + F.lit(4)))
    catalog.register(spark, tiny)
    text = plan(spark.sql("SELECT 1 FROM nation, region WHERE n_regionkey = r_regionkey"))
    assert "Cartesian" not in text and "NestedLoop" not in text
