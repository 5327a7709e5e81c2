"""Sums, groups, counts and upserts by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ordering import fresh

WRAP = 1 << 32


def reduce_sum(df: DataFrame, value: str, name: str = "s") -> DataFrame:
    """One row; 0 for an empty table."""
    return df.agg(F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0)).alias(name))


def group_sum(df: DataFrame, key: str, value: str, name: str = "s") -> DataFrame:
    """Partial sums per task, one exchange, final sums."""
    return df.groupBy(key).agg(F.sum(F.col(value).cast("long")).alias(name))


def group_sum_two_phase(df: DataFrame, key: str, value: str, executors: int = 1024, name: str = "s") -> DataFrame:
    """Private sums of `executors` slices of each key's rows, then their merge: a hot key is dealt over the slices. The
    second exchange is the price; `group_sum`, whose partial sums tame hot keys as well, is the one to use by default."""
    slice_, part = fresh(df, "slice", "part")
    slices = df.withColumn(slice_, F.pmod(F.monotonically_increasing_id(), F.lit(executors)))
    local = slices.groupBy(key, slice_).agg(F.sum(F.col(value).cast("long")).alias(part))
    return local.groupBy(key).agg(F.sum(part).alias(name))


def group_sum_dense(df: DataFrame, key: str, value: Column, groups: int, name: str = "s") -> DataFrame:
    """One row for each key 0 .. groups-1; groups without rows have 0."""
    sums = df.groupBy(F.col(key).cast("long").alias(key)).agg(F.sum(value).alias(name))
    every = df.sparkSession.range(groups).withColumnRenamed("id", key)
    return every.join(sums, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def group_sum_wrap32(df: DataFrame, key: str, value: Column, name: str = "s") -> DataFrame:
    """Sums modulo 2**32, as unsigned 32-bit addition gives."""
    return df.groupBy(key).agg(F.pmod(F.sum(value), F.lit(WRAP)).alias(name))


def fold(df: DataFrame, key: str, value: str, start: Column, step: Callable[[Column, Column], Column], order: str, name: str = "folded") -> DataFrame:
    """A binary fold of each group's values in an order. It gathers a group in one row: for bounded groups only."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.groupBy(key).agg(F.aggregate(values, start, step).alias(name))


def upsert_last(df: DataFrame, key: str, value: str, order: str, name: str = "last") -> DataFrame:
    """Each key's value with the greatest order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(name))


def upsert_add(df: DataFrame, key: str, value: str, name: str = "s") -> DataFrame:
    return group_sum(df, key, value, name)


def distinct_count(df: DataFrame, value: str, name: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(value).alias(name))


def counter(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))
