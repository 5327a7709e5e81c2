"""Runs an operator at chosen sizes and iteration counts, checks its result against an independent computation in
plain Python, and reports timings."""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill import plans
from grainmill.operators import aggregate, join, membership, ordering, project, scan
from grainmill.sources import append_csv, constant_column, random_ints, unique_ints


PHASES = ("executor", "build", "probe", "group", "reduce")


@dataclass
class RunConfig:
    operator: str
    sizes: list[int] = field(default_factory=lambda: [1])
    iterations: int = 1
    strategy: str | None = None
    groups: int = 64
    executors: int = 1024
    threshold: int = 5
    seed: int = 0


@dataclass
class Measurement:
    operator: str
    strategy: str
    rows: int
    bytes: int
    iteration: int
    seconds: float
    valid: bool
    executor_seconds: float = 0.0
    build_seconds: float = 0.0
    probe_seconds: float = 0.0
    group_seconds: float = 0.0
    reduce_seconds: float = 0.0


@dataclass(frozen=True)
class Operator:
    """inputs -> frames; build -> the lazy result; expected -> the rows it must have, as a bag."""

    inputs: Callable[[SparkSession, RunConfig, int], list[DataFrame]]
    build: Callable[[list[DataFrame], RunConfig], DataFrame]
    expected: Callable[[list[list], RunConfig], Counter]


def _one(spark, c, n):
    return [random_ints(spark, n, 1, 10000, c.seed)]


def _keys(spark, c, n):
    return [unique_ints(spark, n, c.seed, "k")]


def _two(make):
    def inputs(spark, c, n):
        return [make(spark, c, n, s).select("k", F.col("row_id").alias(v)) for s, v in ((c.seed, "va"), (c.seed + 1, "vb"))]

    return inputs


def _group(spark, c, n):
    keys = random_ints(spark, n, 0, c.groups - 1, c.seed, "k")
    return [keys.join(random_ints(spark, n, 1, 10000, c.seed + 1, "v"), "row_id")]


_unique = _two(lambda s, c, n, seed: unique_ints(s, n, seed, "k"))
_dups = _two(lambda s, c, n, seed: random_ints(s, n, 1, 10000, seed, "k"))


def _sums(rows) -> Counter:
    out: Counter = Counter()
    for r in rows:
        out[r["k"]] += r["v"]
    return out


def _pairs(sides, c) -> Counter:
    by: dict = {}
    for r in sides[0]:
        by.setdefault(r["k"], []).append(r["va"])
    return Counter((r["k"], va, r["vb"]) for r in sides[1] for va in by.get(r["k"], []))


def _ranked(sides, c) -> Counter:
    order = sorted((r["x"], r["row_id"]) for r in sides[0])
    return Counter((x, i, k + 1) for k, (x, i) in enumerate(order))


def _prefix(sides, c) -> Counter:
    total, out = 0, Counter()
    for r in sorted(sides[0], key=lambda r: r["row_id"]):
        out[r["row_id"], total] += 1
        total += r["x"]
    return out


def _many(sides, c) -> Counter:
    n, total = Counter(), Counter()
    for r in sides[0]:
        n[r["k"]] += 1
        total[r["k"]] += r["va"]
    return Counter((r["k"], r["vb"], n[r["k"]], total[r["k"]]) for r in sides[1])


def _probe(sides, c) -> Counter:
    built = {x["k"] for x in sides[0]}
    return Counter((x["k"], x["k"] in built) for x in sides[1])


OPERATORS: dict[str, Operator] = {
    "constant": Operator(lambda s, c, n: [constant_column(s, n, 0)], lambda f, c: project.constant(f[0]).select("row_id", "c"), lambda r, c: Counter((x["row_id"], 42) for x in r[0])),
    "vector_add": Operator(lambda s, c, n: [random_ints(s, n, seed=c.seed).withColumn("y", F.col("row_id"))], lambda f, c: project.vector_add(f[0], "x", "y").select("row_id", "total"), lambda r, c: Counter((x["row_id"], x["x"] + x["y"]) for x in r[0])),
    "scan": Operator(_one, lambda f, c: scan.scan_less_than(f[0], "x", c.threshold).select("row_id", "x"), lambda r, c: Counter((x["row_id"], x["x"]) for x in r[0] if x["x"] < c.threshold)),
    "sort": Operator(_one, lambda f, c: ordering.row_numbers(f[0], ["x", "row_id"]).select("x", "row_id", "rn"), _ranked),
    "prefix_sum": Operator(_one, lambda f, c: ordering.prefix_sum(f[0], "row_id", "x").select("row_id", "before"), _prefix),
    "reduce": Operator(_one, lambda f, c: aggregate.reduce_sum(f[0], "x"), lambda r, c: Counter([(sum(x["x"] for x in r[0]),)])),
    "group_by": Operator(_group, lambda f, c: aggregate.group_sum(f[0], "k", "v"), lambda r, c: Counter(_sums(r[0]).items())),
    "group_by_two_phase": Operator(_group, lambda f, c: aggregate.group_sum_two_phase(f[0], "k", "v", c.executors), lambda r, c: Counter(_sums(r[0]).items())),
    "group_by_dense": Operator(_group, lambda f, c: aggregate.group_sum_dense(f[0], "k", F.col("v"), c.groups), lambda r, c: Counter((k, _sums(r[0])[k]) for k in range(c.groups))),
    "join": Operator(_unique, lambda f, c: join.inner_join(f[1], f[0], "k", c.strategy).select("k", "va", "vb"), _pairs),
    "join_duplicates": Operator(_dups, lambda f, c: join.inner_join(f[1], f[0], "k", c.strategy).select("k", "va", "vb"), _pairs),
    "nested_loop_join": Operator(_dups, lambda f, c: join.nested_loop_join(f[1].withColumnRenamed("k", "k2"), f[0], "k2", "k").select("k", "va", "vb"), _pairs),
    "join_one_to_many": Operator(_dups, lambda f, c: join.one_to_many(f[1], f[0], "k", "va").select("k", "vb", "n", "total"), _many),
    "hash_build": Operator(_keys, lambda f, c: membership.build_multiset(f[0], "k").select("k"), lambda r, c: Counter((x["k"],) for x in r[0])),
    "hash_build_distinct": Operator(lambda s, c, n: [random_ints(s, n, 1, 10000, c.seed, "k")], lambda f, c: membership.build_set(f[0], "k"), lambda r, c: Counter((k,) for k in {x["k"] for x in r[0]})),
    "hash_probe": Operator(lambda s, c, n: [*_keys(s, c, n), s.range(10 * n).withColumnRenamed("id", "k")], lambda f, c: membership.flags(f[1], f[0], "k").select("k", "found"), _probe),
}


def measure(spark: SparkSession, config: RunConfig, check_up_to: int = 100_000) -> list[Measurement]:
    """Times the whole execution (a noop write) after inputs are cached, and its phases (see plans.phases); results of up to `check_up_to` rows are
    compared with the plain computation. bytes counts eight per value of the first input's key or value column."""
    if config.operator not in OPERATORS:
        raise ValueError(f"unknown operator {config.operator}; known: {', '.join(sorted(OPERATORS))}")
    op, out = OPERATORS[config.operator], []
    for n in config.sizes:
        frames = [f.persist() for f in op.inputs(spark, config, n)]
        try:
            for f in frames:
                f.count()
            for k in range(config.iterations):
                result, took = op.build(frames, config), 0.0

                def run(result: DataFrame = result) -> None:
                    nonlocal took
                    began = time.perf_counter()
                    result.write.format("noop").mode("overwrite").save()
                    took = time.perf_counter() - began

                spent, valid = plans.phases(spark, run), True
                if n <= check_up_to:
                    got = Counter(tuple(r) for r in result.collect())
                    valid = got == op.expected([[r.asDict() for r in f.collect()] for f in frames], config)
                out.append(Measurement(config.operator, config.strategy or "planned", n, 8 * n, k, took, valid, *[round(spent[p], 4) for p in PHASES]))
        finally:
            for f in frames:
                f.unpersist()
    return out


def write_report(path: str, found: list[Measurement]) -> None:
    append_csv(path, [vars(m) for m in found])


def random_seed(source: int = 0) -> int:
    """A scalar in 1 .. 1000 for hash functions, the same for the same source."""
    return random.Random(source).randint(1, 1000)
