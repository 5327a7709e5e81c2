"""Inner equi-joins in their physical variants, and one-to-many joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ordering import fresh

#: A nested loop join's buckets of keys, for keys of these types, and the most rows in a block of one bucket.
BUCKETS, BLOCK = 4096, 1024
PLAIN_TYPES = r"boolean|tinyint|smallint|int|bigint|float|double|decimal\(\d+,\d+\)|string|binary|date|timestamp|timestamp_ntz"
#: Our names for join strategies, and Spark's hints; None leaves the choice to the planner.
STRATEGIES = {"broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}


def hinted(df: DataFrame, strategy: str | None) -> DataFrame:
    if strategy is None:
        return df
    return df.hint(STRATEGIES[strategy])


def inner_join(probe: DataFrame, build: DataFrame, key: str, strategy: str | None = None) -> DataFrame:
    """All pairs with equal keys, duplicates kept. `broadcast` is for build sides of a known size; without a strategy
    the planner broadcasts only what its statistics prove small."""
    return probe.join(hinted(build, strategy), key)


def first_match(probe: DataFrame, build: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each probe row with the value of the build row of least order; rows without a match are left out."""
    least = build.groupBy(key).agg(F.min_by(value, order).alias(value))
    return probe.join(least, key)


def blocks(df: DataFrame, key: Column, name: str, rows: str, size: int) -> DataFrame:
    """The rows as lists of at most `size` with equal values of `key`. Rows are cut in their order within a partition, by all columns
    that have one, so a task that is run again cuts them alike."""
    number, place = fresh(df, "number")[0], F.monotonically_increasing_id()
    once = [f for f in df.schema if [c.lower() for c in df.columns].count(f.name.lower()) == 1]
    own = [F.col(f"`{f.name}`") for f in once if not re.search("map<|variant", f.dataType.simpleString())]
    cut = df.sortWithinPartitions(key, *own).select(key.alias(name), F.struct("*").alias(rows), (place - place % size).alias(number))
    return cut.groupBy(name, number).agg(F.collect_list(rows).alias(rows)).select(name, rows)


def nested_loop_join(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Compares every row of a with every block of b, a block being at most BLOCK rows of one bucket of keys, and, where
    the buckets are equal, with every row in it. The rows of a are dealt evenly, so pairs are made by all cores, however
    few partitions a has. For small sides, where that is what is asked for; its time is that of its result at least."""
    bucket, name, rows = fresh(a.crossJoin(b), "bucket", "block_bucket", "block_rows")
    kinds = {df.select(key).schema[0].dataType.simpleString() for df, key in ((a, left), (b, right))}
    hashed = len(kinds) == 1 and re.fullmatch(PLAIN_TYPES, *kinds)  # keys of two types are equal by casts: no buckets
    of = lambda key: F.when(F.col(key).isNotNull(), F.xxhash64(key) % BUCKETS) if hashed else F.col(key)
    parts = max(a.sparkSession.sparkContext.defaultParallelism, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = a.repartition(parts).withColumn(bucket, of(left))
    found = dealt.join(hinted(blocks(b, of(right), name, rows, BLOCK), "nested_loop"), F.col(bucket) == F.col(name))
    pairs = found.drop(bucket, name).select("*", F.inline(rows)).drop(rows)
    return pairs.where(F.col(left) == F.col(right)) if hashed else pairs


def one_to_many(probe: DataFrame, build: DataFrame, key: str, payload: str, count: str = "n", total: str = "total") -> DataFrame:
    """Every probe row with the count and the payload sum of its build rows, 0 without any. Build rows are aggregated
    before the join, so a hot key moves as one row."""
    grouped = build.groupBy(key).agg(F.count("*").alias(count), F.sum(F.col(payload).cast("long")).alias(total))
    return probe.join(grouped, key, "left").withColumns({count: F.coalesce(count, F.lit(0)), total: F.coalesce(total, F.lit(0))})


def one_to_many_ids(probe: DataFrame, build: DataFrame, key: str, build_id: str, name: str = "ids") -> DataFrame:
    """Every probe row with the ascending list of its build rows' ids, empty without any. A list is one row's value,
    as the operator is defined; where a key may have very many rows, use inner_join, its flat form."""
    grouped = build.groupBy(key).agg(F.sort_array(F.collect_list(build_id)).alias(name))
    return probe.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{build.schema[build_id].dataType.simpleString()}>")))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one frame holds more often than the other, as often as it does; none if they are equal as bags. One
    sum over both: a union of two differences can lose its partitioning under adaptive execution (Spark 4.1)."""
    n, k = fresh(a, "n", "k")
    both = a.withColumn(n, F.lit(1)).unionAll(b.withColumn(n, F.lit(-1)))
    columns = [F.col(f"`{c}`") for c in a.columns]
    odd = both.groupBy(*columns).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
    return odd.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.abs(n)))).select(*columns)


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often, in any order."""
    return bag_difference(a, b).isEmpty()
