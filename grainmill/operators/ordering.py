"""Sorting, global row numbers and prefix sums.

A window without partitions would gather all rows in one task. Rows go to ordered buckets instead, by bounds over all
keys; buckets are counted or summed, the few totals are scanned, and each bucket is numbered by itself. The bounds are
quantiles of a sample, the rows of least hash, found within the same lazy plan; the same rows give the same bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20  # rows for each bucket
FEW = 32  # buckets up to which every bound is compared in generated code


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made such that the frame has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def sort_ascending(df: DataFrame, *keys: str) -> DataFrame:
    """A range exchange and sorts within partitions; nulls first."""
    return df.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys])


def _in_buckets(df: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """With the number of bounds below each row's keys, found in two steps of about the square root of their number. Keys
    compare as structs, nulls first, so they may be of any ordered type."""
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * buckets)  # a top-n, no full sort
    every = F.sort_array(F.collect_list("k"))  # SAMPLE x buckets rows at most
    sample = sample.agg(every.alias("s")).withColumn("n", F.size("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(buckets - 1, 1))), lambda i: F.element_at("s", F.greatest(F.lit(1), (i * F.col("n") / buckets).cast("int"))))
    bounds = sample.select(F.when(F.col("n") > 0, F.array_distinct(at)).otherwise(F.slice("s", 1, 0)).alias("b"))
    width = max(1, math.isqrt(buckets))
    coarse = F.filter("b", lambda x, i: (i + 1) % width == 0)
    fine = F.transform(F.sequence(F.lit(0), (F.size("b") / width).cast("int")), lambda i: F.slice("b", i * width + 1, F.lit(width)))
    found, part = fresh(df, "found", "part")
    if buckets <= FEW:
        out = df.withColumn(found, bounds.scalar())
        below = [F.when(F.get(F.col(found), F.lit(i)) < key, 1).otherwise(0) for i in range(buckets - 1)]
        return out.withColumn(name, sum(below, F.lit(0))).drop(found)
    out = df.withColumn(found, bounds.select(F.struct(coarse.alias("coarse"), fine.alias("fine"))).scalar())
    out = out.withColumn(part, F.size(F.filter(F.col(found)["coarse"], lambda b: b < key)))
    inside = F.size(F.filter(F.element_at(F.col(found)["fine"], F.col(part) + 1), lambda b: b < key))
    return out.withColumn(name, F.col(part) * width + inside).drop(found, part)


def _buckets(df: DataFrame, buckets: int | None) -> int:
    return buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_numbers(df: DataFrame, keys: list[str], name: str = "rn", buckets: int | None = None) -> DataFrame:
    """Global row number from 1 in the order of the keys, which should be unique together. buckets: as many as there are
    shuffle partitions, unless given."""
    bucket, inside, before = fresh(df, "bucket", "inside", "before")
    at = _in_buckets(df, keys, _buckets(df, buckets), bucket)
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    totals = at.groupBy(bucket).agg(F.count("*").alias("n")).select(bucket, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(before))
    own = Window.partitionBy(bucket).orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys])
    out = at.withColumn(inside, F.row_number().over(own)).join(F.broadcast(totals), bucket)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(inside) + F.col(before)).cast("long").alias(name))


def prefix_sum(df: DataFrame, order: str, value: str, name: str = "before", inclusive: bool = False, initial: int = 0, buckets: int | None = None) -> DataFrame:
    """Sum of the values of all rows before this one in the order of a unique key; with inclusive, its own too."""
    bucket, inside, before = fresh(df, "bucket", "inside", "earlier")
    at = _in_buckets(df, [order], _buckets(df, buckets), bucket)
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    v = F.col(f"`{value}`")
    totals = at.groupBy(bucket).agg(F.sum(v).alias("s")).select(bucket, F.coalesce(F.sum("s").over(upto), F.lit(0)).alias(before))
    own = Window.partitionBy(bucket).orderBy(F.col(f"`{order}`").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = at.withColumn(inside, F.coalesce(F.sum(v).over(own), F.lit(0))).join(F.broadcast(totals), bucket)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(inside) + F.col(before) + F.lit(initial)).alias(name))
