"""Rolling totals over trailing periods, days without activity included.

Counts are aggregated to (entity, day) first, so nothing later grows with the number of events:
an entity has at most one row per calendar day. Cumulative sums per entity are forward-filled over
every day of the entity's span; a trailing total is the difference of two prefix values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(daily: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, day, total_1d, total_{p}d, avg_{p}d ...) for each day from an entity's first to its last.

    `daily` holds (entity, day DATE, value); repeated (entity, day) rows are summed, null values count
    as 0, rows with a null entity or day are left out. An empty table gives an empty result. The
    average is over the p days of the period, also before the entity's first day.
    """
    base = (
        daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(F.col(entity).alias("_e"), F.col(day).alias("_d"), F.coalesce(F.col(value), F.lit(0)).alias("_v"))
        .groupBy("_e", "_d").agg(F.sum("_v").alias("_v"))
    )
    w = Window.partitionBy("_e").orderBy("_d")
    marks = base.select(
        "_e", "_d", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.lead("_d").over(w).alias("_n")
    )
    # Forward fill: the prefix value of an active day stands until the day before the next active one.
    filled = marks.select(
        "_e", "_c", "_d", F.explode(F.sequence("_d", F.coalesce(F.date_sub("_n", 1), F.col("_d")))).alias("_x")
    )
    out = filled.select("_e", F.col("_x").alias("_d"), "_c")
    # Every day of the span has a row, so p days back is p rows back.
    before = {p: F.coalesce(F.lag("_c", p).over(w), F.lit(0)) for p in {1, *periods}}
    cols = [(F.col("_c") - before[1]).alias("total_1d")]
    for p in periods:
        cols += [(F.col("_c") - before[p]).alias(f"total_{p}d"), ((F.col("_c") - before[p]) / F.lit(float(p))).alias(f"avg_{p}d")]
    return out.select(F.col("_e").alias(entity), F.col("_d").alias(day), *cols)
