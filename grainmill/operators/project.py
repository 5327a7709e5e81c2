"""Constant projection, vector addition, rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constant(df: DataFrame, value: int = 42, name: str = "c") -> DataFrame:
    """The columns and a constant one."""
    return df.withColumn(name, F.lit(value))


def vector_add(df: DataFrame, a: str, b: str, name: str = "total") -> DataFrame:
    """The columns and the sum of two, widened so that it cannot overflow."""
    return df.withColumn(name, F.col(a).cast("long") + F.col(b).cast("long"))


def to_rows(df: DataFrame, chunk: Column, name: str = "rows") -> DataFrame:
    """Row layout: an array of structs for each chunk. A chunk is held in one row, so chunks are of bounded size."""
    return df.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct(*df.columns)).alias(name))


def to_columns(rows: DataFrame, columns: list[str], name: str = "rows") -> DataFrame:
    """Column layout: an array for each column and chunk, all of a chunk's of one length."""
    return rows.select("chunk", *[F.col(name)[c].alias(c) for c in columns])


def zip_columns(*arrays: Column) -> Column:
    """Arrays of equal length as one array of structs."""
    return F.arrays_zip(*arrays)


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows again from the column layout."""
    return df.select(F.inline(zip_columns(*[F.col(c) for c in columns])))
