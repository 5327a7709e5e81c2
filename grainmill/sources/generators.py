"""Seeded synthetic columns, made in parallel by `spark.range`; equal arguments give equal columns."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.ordering import row_numbers


def random_ints(spark: SparkSession, n: int, low: int = 1, high: int = 10000, seed: int = 0, name: str = "x") -> DataFrame:
    """n whole numbers, uniform in [low, high], with duplicates."""
    if high < low:
        raise ValueError("high is below low")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(high - low + 1)) + low
    return spark.range(n).select(F.col("id").alias("row_id"), draw.alias(name))


def _shuffled(x: Column, size: int, seed: int) -> Column:
    """A permutation of 0 .. size-1: rounds of an odd factor and a shift on the next power of two, repeated until the
    number is below size again, which 64 repetitions leave out once in 2**64 cases."""
    bits = max(2, (size - 1).bit_length())
    r = random.Random(seed)
    odd, add = [r.randrange(1 << min(bits, 30)) | 1 for _ in range(3)], [r.randrange(1 << bits) for _ in range(3)]

    def once(v: Column) -> Column:
        for a, b in zip(odd, add, strict=True):
            v = F.pmod(v * F.lit(a) + F.lit(b), F.lit(1 << bits)) if bits <= 32 else F.pmod(F.pmod(v, F.lit(1 << 32)) * F.lit(a) + F.lit(b), F.lit(1 << 32)) + F.shiftleft(F.shiftright(v, 32), 32)
            v = v.bitwiseXOR(F.shiftright(v, max(1, bits // 2)))
        return v

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x), lambda v, _: F.when(v < size, v).otherwise(once(v)))


def unique_ints(spark: SparkSession, n: int, seed: int = 0, name: str = "x") -> DataFrame:
    """n distinct whole numbers out of [0, 10n), any n of them alike, ascending with row_id."""
    numbers = spark.range(10 * n).where(_shuffled(F.col("id"), max(10 * n, 1), seed) < n).withColumnRenamed("id", name)
    return row_numbers(numbers, [name], "row_id").select((F.col("row_id") - 1).alias("row_id"), name)


def random_bits(spark: SparkSession, n: int, seed: int = 0, name: str = "x") -> DataFrame:
    """n zeros and ones."""
    return random_ints(spark, n, 0, 1, seed, name)


def ramp(spark: SparkSession, n: int, name: str = "x") -> DataFrame:
    """0 .. n-1."""
    return spark.range(n).select(F.col("id").alias("row_id"), F.col("id").alias(name))


def constant_column(spark: SparkSession, n: int, value: int, name: str = "x") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), F.lit(value).alias(name))
