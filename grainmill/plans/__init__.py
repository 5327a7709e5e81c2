"""Looking at plans: which strategy ran, what reached the scan, and where time went."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

JOIN_NODES = {"broadcast": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin", "merge": "SortMergeJoin", "nested_loop": "CartesianProduct"}


def executed_plan(df: DataFrame, run: bool = True) -> str:
    """The physical plan; with run, after execution, as adaptive execution left it."""
    if run:
        df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> list[str]:
    return re.findall(r"(\w*Join\w*|CartesianProduct|HashAggregate|SortAggregate|Exchange|Window|Sort)\b", executed_plan(df))


def pushed_filters(df: DataFrame) -> str:
    found = re.findall(r"PushedFilters: \[([^\]]*)\]", executed_plan(df, run=False))
    return " ".join(found)


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return [c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", executed_plan(df, run=False)) for c in s.split(",") if c]


UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0}


def _seconds(text: str) -> float:
    """Of a metric as Spark prints it: the total, which stands first."""
    m = re.match(r"([\d.,]+) (ms|s|min|m|h)\b", text.rpartition("\n")[2])
    return float(m[1].replace(",", "")) * UNITS[m[2]] if m else 0.0


def phases(spark: SparkSession, run: Callable[[], None]) -> dict[str, float]:
    """Seconds that the queries in `run` spent, from Spark's SQL metrics and stages: executor (run time of all tasks);
    build (collecting, building and sending hash tables, or sorting for a merge join) and probe (executor time of a join
    beyond that); group (partial aggregation) and reduce (final). 0 where a plan has no such phase."""
    context = spark.sparkContext._jsc.sc()
    executions = spark._jsparkSession.sharedState().statusStore()

    def stages() -> dict[int, int]:
        gateway = spark.sparkContext._gateway
        found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(found.apply(k).stageId(), found.apply(k).attemptId()): found.apply(k).executorRunTime() for k in range(found.size())}

    def last() -> list[int]:
        """Numbers of the executions that Spark still holds; it drops old ones."""
        found = executions.executionsList()
        return [found.apply(k).executionId() for k in range(found.size())]

    context.listenerBus().waitUntilEmpty()
    known, old = max(last(), default=-1), stages()
    run()
    context.listenerBus().waitUntilEmpty()
    out = dict.fromkeys(("executor", "build", "probe", "group", "reduce"), 0.0)
    out["executor"] = sum(ms for k, ms in stages().items() if k not in old) / 1000
    joins = False
    for number in [e for e in last() if e > known]:
        values, nodes = executions.executionMetrics(number), executions.planGraph(number).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            joins |= "Join" in node.name() or "CartesianProduct" in node.name()
            for j in range(node.metrics().size()):
                metric = node.metrics().apply(j)
                took = values.get(metric.accumulatorId())
                took = _seconds(took.get()) if took.isDefined() else 0.0
                if metric.name() in ("time to collect", "time to build", "time to broadcast", "time to build hash map") or metric.name() == "sort time" and node.name() == "Sort":
                    out["build"] += took
                elif metric.name() == "time in aggregation build":
                    out["group" if "partial_" in node.desc() else "reduce"] += took
    if joins:
        out["probe"] = max(0.0, out["executor"] - out["build"])
    else:
        out["build"] = 0.0
    return out
