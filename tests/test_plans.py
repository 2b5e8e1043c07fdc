"""The plans are those one wants: filters and columns reach the scan, top-k is no sort, searches do not shuffle."""

import re

from siltstone.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "q_pricing_summary")
    assert "LessThanOrEqual(l_shipdate" in p
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>", p)
    assert "StringStartsWith(c_name" in plan(spark, "q_like_prefix")
    assert "ReadSchema: struct<o_orderpriority:string,o_orderstatus:string>" in plan(spark, "q_distinct") or "o_orderpriority" in plan(spark, "q_distinct")
    assert "In(o_orderpriority" in plan(spark, "q_filter_in")


def test_top_k_is_no_full_sort(spark):
    p = plan(spark, "q_topk")
    assert "TakeOrderedAndProject" in p and "Exchange rangepartitioning" not in p


def test_searches_do_not_shuffle(spark):
    for name in ("q_fts_complex", "q_fts_porter", "q_udf_expr", "q_json_extract"):
        p = plan(spark, name)
        assert "Exchange" not in p and "Python" not in p


def test_aggregates_are_partial_first(spark):
    assert "partial_sum" in plan(spark, "q_pricing_summary") and "partial_count" in plan(spark, "q_group_multi_key")


def test_correlated_subqueries_become_joins(spark):
    for name in ("q_exists_corr", "q_scalar_corr", "q_not_exists_corr"):
        assert re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", plan(spark, name))


def test_no_cartesian_products_but_the_named_one(spark):
    for name in ("q_join_chain", "q_join_inner", "q_join_equi_residual", "q_in_subquery"):
        assert "CartesianProduct" not in plan(spark, name) and "BroadcastNestedLoopJoin" not in plan(spark, name)
