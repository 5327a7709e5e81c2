"""Build a set of keys, probe it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.join import hinted


def build_multiset(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Keys dealt by hash, duplicates kept."""
    return df.repartition(partitions, key) if partitions else df.repartition(key)


def build_set(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys."""
    return df.select(key).distinct()


def members(probe: DataFrame, build: DataFrame, key: str, strategy: str | None = None) -> DataFrame:
    """Probe rows whose key was built."""
    return probe.join(hinted(build.select(key), strategy), key, "left_semi")


def strangers(probe: DataFrame, build: DataFrame, key: str, strategy: str | None = None) -> DataFrame:
    """Probe rows whose key was not built."""
    return probe.join(hinted(build.select(key), strategy), key, "left_anti")


def flags(probe: DataFrame, build: DataFrame, key: str, name: str = "found") -> DataFrame:
    """Every probe row with whether its key was built."""
    marked = build.select(key).distinct().withColumn(name, F.lit(True))
    return probe.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
