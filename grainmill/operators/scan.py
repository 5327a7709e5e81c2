"""Filter with compaction, and the offsets at which chunks of survivors are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ordering import prefix_sum


def scan_less_than(df: DataFrame, column: str, threshold: float = 5) -> DataFrame:
    """Rows below the threshold; the comparison reaches the scan. Nulls are not below anything."""
    return df.where(F.col(column) < threshold)


def compaction_offsets(df: DataFrame, chunk: Column, keep: Column) -> DataFrame:
    """chunk, n, first: survivors of each chunk and where they start when chunks are written in order. The counts, one
    row per chunk, are ordered by buckets, so no task gathers all of them."""
    counts = df.groupBy(chunk.alias("chunk")).agg(F.count(F.when(keep, 1)).alias("n"))
    return prefix_sum(counts, "chunk", "n", "first")
