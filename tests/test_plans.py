"""Each variant uses the strategy that it claims, and filters and columns reach the scan."""

import pytest
from pyspark.sql import functions as F

from grainmill import catalog, plans
from grainmill.operators import aggregate, join, ordering, report, scan
from grainmill.sources import read_table


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle_hash", "merge"])
def test_join_strategies(spark, sf_dir, strategy):
    a = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_partkey")
    b = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey")
    assert plans.JOIN_NODES[strategy] in plans.executed_plan(join.inner_join(a, b, "k", strategy))


def test_nested_loop_strategy(spark, sf_dir):
    a = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    b = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    assert plans.JOIN_NODES["nested_loop"] in plans.executed_plan(join.nested_loop_join(a, b, "c_nationkey", "s_nationkey"))


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    df = scan.scan_less_than(read_table(spark, sf_dir, "lineitem"), "l_quantity", 5).select("l_orderkey")
    assert "LessThan(l_quantity,5.0)" in plans.pushed_filters(df)
    assert sorted(plans.read_columns(df)) == ["l_orderkey", "l_quantity"]


def test_group_sum_is_partial_then_final_with_one_exchange(spark, sf_dir):
    df = aggregate.group_sum(read_table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber")
    plan = plans.executed_plan(df, run=False)
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["sort_asc", "prefix_exclusive", "compaction_offsets"])
def test_ordering_gathers_only_totals(spark, sf_dir, name):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    start = jobs()
    read_table(spark, sf_dir, "events")
    own = jobs() - start  # of reading a schema
    df = catalog.QUERIES[name](spark, sf_dir)
    assert jobs() - start == 2 * own  # building the frame runs nothing else
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for node in [line for line in plan.splitlines() if "Window [" in line]:
        assert "[bucket" in node  # either within a bucket or over the buckets' totals
    assert df.count() > 0


def test_compaction_offsets_over_growing_chunks(spark):
    df = spark.range(3000).withColumn("v", F.col("id") % 3)
    got = scan.compaction_offsets(df, F.col("id"), F.col("v") == 0)
    plan = plans.executed_plan(got)
    counts = [line for line in plan.splitlines() if "Window [sum(n#" in line and ", [chunk#" in line]
    assert counts and all("[bucket" in line for line in counts)
    rows = sorted(map(tuple, got.collect()))
    assert [r[2] for r in rows] == [(k + 2) // 3 for k in range(3000)]


def test_report_moves_counts_only(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "cast(value as long) as v")
    plan = plans.executed_plan(report.trimmed_mean(events, "user_id", "event_type", "v", ["view"]))
    assert "Window" not in plan and "partial_count" in plan


def test_phases_of_joins_and_groups(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_partkey")
    orders = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey")
    run = lambda df: plans.phases(spark, lambda: df.write.format("noop").mode("overwrite").save())
    for strategy in ("broadcast", "shuffle_hash", "merge"):
        found = run(join.inner_join(items, orders, "k", strategy))
        assert found["executor"] > 0 and found["build"] + found["probe"] > 0 and found["probe"] <= found["executor"]
    found = run(aggregate.group_sum(items, "k", "l_partkey"))
    assert found["executor"] > 0 and found["build"] == found["probe"] == 0 and found["group"] + found["reduce"] >= 0
    assert plans._seconds("total (min, med, max (stageId: taskId))\n1.5 s (0 ms, 3 ms, 1 s (stage 3.0: task 4))") == 1.5 and plans._seconds("24 ms") == 0.024
