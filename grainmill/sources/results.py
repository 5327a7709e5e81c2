"""Measurement rows in one CSV file that grows: the header is written only when the file is new."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession

PHASES = ["executor_seconds", "build_seconds", "probe_seconds", "group_seconds", "reduce_seconds"]
COLUMNS = ["operator", "strategy", "rows", "bytes", "iteration", "seconds", "valid", *PHASES]
SCHEMA = "operator string, strategy string, rows long, bytes long, iteration int, seconds double, valid boolean, " + ", ".join(f"{p} double" for p in PHASES)


def append_csv(path: str, rows: list[dict]) -> None:
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="") as f:
        out = csv.DictWriter(f, COLUMNS)
        if new:
            out.writeheader()
        out.writerows(rows)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(SCHEMA).csv(path)
