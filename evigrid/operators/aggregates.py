"""Grouped summaries: declared aggregates, top counts, histograms, latest rows, rates and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count}


def declared(specs: dict[str, tuple[str, str]]) -> list[Column]:
    """Aggregates {name: (op, field)} as doubles; null over no rows, also for count and sum."""
    unknown = [op for op, _ in specs.values() if op not in _OPS]
    if unknown:
        raise ValueError(f"unknown aggregate: {unknown[0]}")
    return [F.nullif(_OPS[op](F.col(f).cast("double")).cast("double"), F.lit(0.0)).alias(n) if op == "count" else _OPS[op](F.col(f).cast("double")).alias(n) for n, (op, f) in specs.items()]


def top_counts(df: DataFrame, by: list[str], value: Column, order: Column, n: int = 5) -> DataFrame:
    """The n most frequent values of each group; missing and empty ones are "?"; ties go to the value seen first."""
    name = F.when(F.trim(value) == "", None).otherwise(F.trim(value))
    counted = df.withColumn("value", F.coalesce(name, F.lit("?"))).groupBy(*by, "value").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    if not by:  # each task keeps its first n, so that few rows are ranked in one
        counted = counted.orderBy(F.desc("n"), "_first").limit(n)
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), "_first")
    ranked = counted.withColumn("rank", F.row_number().over(window).cast("long"))
    return ranked.where(F.col("rank") <= n).drop("_first")


def latest(df: DataFrame, by: list[str], date: Column, order: Column) -> DataFrame:
    """The row of each group with the largest date; the first in order on ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(date.desc(), order.asc()))).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")


def rate(condition: Column, of: Column) -> Column:
    """The share of rows of a kind that meet a condition; 0 without such rows."""
    return F.count_if(condition & of).cast("double") / F.greatest(F.count_if(of), F.lit(1))


def fractions(df: DataFrame, by: list[str], cls: str) -> DataFrame:
    """The share of each class in each group, and whether it is the dominant one (the lowest on ties)."""
    counted = df.groupBy(*by, cls).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    best = F.row_number().over(group.orderBy(F.desc("n"), F.col(cls)))
    return counted.select(*by, cls, "n", (F.col("n") / F.sum("n").over(group)).alias("fraction"), (best == 1).alias("dominant"))


def zonal_plain(value: str) -> list[Column]:
    """n, min and max of the finite values of a zone (its quantiles are in ``quantiles``)."""
    v = F.when(~F.isnan(value), F.col(value))
    return [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max")]


def full_outer_delta(a: DataFrame, b: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Both runs side by side: the values, their difference, and what became of each key."""
    both = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key, "full_outer")
    delta = F.col("after") - F.col("before")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(delta > threshold, "up").when(delta < -threshold, "down").otherwise("same")
    return both.select(key, "before", "after", delta.alias("delta"), state.alias("state"))
