"""The trimmed report: drop each group's slowest rows, average the rest, one column per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trimmed_mean(df: DataFrame, rows: str, category: str, value: str, categories: list[str]) -> DataFrame:
    """One row per `rows`, per category the mean of the values that are not the group's maximum (all ties go); null where
    none is left, and no row where no group of it has any. Equal values are counted before anything moves, so a hot
    group costs its distinct values. The categories are given, so no pass is needed to find them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(rows, category, value).agg(F.count("*").alias("_n"))
    groups = counts.groupBy(rows, category).agg(F.sum(F.col(value) * F.col("_n")).alias("_s"), F.sum("_n").alias("_all"), F.max(F.struct(value, "_n")).alias("_top"))
    rest = groups.where(F.col("_all") > F.col("_top._n"))
    mean = (F.col("_s") - F.col("_top")[value] * F.col("_top._n")) / (F.col("_all") - F.col("_top._n"))
    return rest.groupBy(rows).pivot(category, categories).agg(F.first(mean))


def bar_chart(means: dict[str, float], width: int = 40) -> str:
    """One line for each category, its bar in proportion to the largest mean; categories without a mean have none."""
    known = {k: v for k, v in means.items() if v is not None}
    most = max(known.values(), default=0.0)
    name = max(map(len, means), default=0)
    return "\n".join(f"{k:<{name}} {'#' * round(width * known[k] / most) if k in known and most > 0 else '':<{width}} {f'{known[k]:.4g}' if k in known else '-'}" for k in sorted(means))
