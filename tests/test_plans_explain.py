"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from cindermap.catalogue import QUERIES
from cindermap.catalogue.standins import table
from cindermap.operators.aggregate import first_per_key, with_group_value
from cindermap.operators.filters import containing
from cindermap.operators.quantiles import exact_quantiles
from cindermap.operators.relate import keyed_join
from cindermap.operators.scale import balscale_many

FOLDER = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


@pytest.mark.parametrize("name", ["risk_aggregate", "fires_per_1k", "incident_blend", "presence_all_years", "point_in_polygon", "multi_year_outer",
                                  "scoped_balscale", "many_to_many", "coverage_by_state", "deciles", "decile_classes", "summary_statistics"])
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["risk_aggregate", "scoped_balscale", "balscale_all", "deciles", "category_rank", "row_chunks"])
def test_windows_see_bounded_tables_only(spark, name):
    # A window that starts with its order has no partitions; only the per-range sizes may have one.
    text = plan(QUERIES[name](spark, FOLDER))
    loose = [line for line in text.splitlines() if re.search(r"windowspecdefinition\([^ ,]+ (ASC|DESC)", line)]
    assert all("__size" in line for line in loose)
    if name in ("category_rank", "row_chunks"):
        assert loose


def test_filters_and_columns_reach_the_scan(spark):
    df = containing(table(spark, FOLDER, "orders"), "o_orderpriority", "HIGH").filter("o_totalprice > 1000").select("o_orderkey")
    text = plan(df)
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


def test_all_scales_share_one_statistics_pass(spark):
    c = table(spark, FOLDER, "customer")
    text = plan(balscale_many(c, {"a": "c_acctbal", "b": F.col("c_nationkey")}))
    assert len(set(re.findall(r"Subquery subquery#\d+", text))) == 1


def test_groups_are_combined_before_the_shuffle(spark):
    l = table(spark, FOLDER, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    text = plan(first_per_key(l, "l_orderkey", ["l_linenumber", "l_partkey"]))
    limit, shuffle = text.index("WindowGroupLimit"), text.index("Exchange")
    assert "Partial" in text and "SortAggregate" not in text and limit < len(text) and shuffle < len(text)
    assert "Window" not in plan(with_group_value(l, "l_orderkey", n=F.count(F.lit(1))))


def test_exact_quantiles_do_not_buffer_all_values(spark):
    # what is left of the query is a table of the answers
    text = plan(exact_quantiles(table(spark, FOLDER, "lineitem"), ["l_extendedprice"], [0.5]))
    assert "parquet" not in text and "Exchange" not in text


def test_null_safe_join_is_hashed(spark):
    o = table(spark, FOLDER, "orders")
    a, b = o.select("o_orderstatus", "o_orderkey"), o.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("m"))
    text = plan(keyed_join(a, b, "o_orderstatus", null_safe=True))
    assert re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", text) and "NestedLoop" not in text
