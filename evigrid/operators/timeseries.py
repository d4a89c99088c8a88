"""Time series: alignment, calendars, gaps, windows, peaks, nearest in time and simple forecasts. A series has key columns, ts, v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned_residual(observed: DataFrame, predicted: DataFrame, key: str, last: int) -> DataFrame:
    """Observed minus predicted at equal times; the last rows of each series."""
    both = observed.select(key, "ts", F.col("v").alias("observed")).join(predicted.select(key, "ts", F.col("v").alias("predicted")), [key, "ts"])
    both = both.withColumn("residual", F.col("observed") - F.col("predicted"))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts")))).where(F.col("_n") <= last).drop("_n")


def hourly(series: DataFrame, key: str) -> DataFrame:
    """Mean of each hour."""
    return series.groupBy(key, F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("v").alias("v"))


def daily_counts(events: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Events of each key and day, from the first to the last day of all events, with zeros for days without any."""
    counted = events.where(condition if condition is not None else F.lit(True)).groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = events.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))  # one row
    calendar = events.select(key).distinct().join(F.broadcast(span)).select(key, F.explode(F.sequence("first", "last")).alias("day"))
    return calendar.join(counted, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def interpolated(series: DataFrame, key: str) -> DataFrame:
    """Hourly means without gaps, from the first to the last known hour: missing hours lie on the line between their neighbours.

    Only known hours are sorted; each fills the gap up to the next one by itself.
    """
    known = hourly(series, key).where("v IS NOT NULL")
    ahead = known.withColumn("next", F.lead(F.struct("hour", "v")).over(Window.partitionBy(key).orderBy("hour")))
    step = F.expr("interval 1 hour")
    every = ahead.withColumnRenamed("hour", "begin").withColumn("hour", F.explode(F.sequence("begin", F.coalesce(F.col("next.hour") - step, "begin"), step)))
    filled = F.col("hour") > F.col("begin")
    share = (F.unix_timestamp("hour") - F.unix_timestamp("begin")) / (F.unix_timestamp("next.hour") - F.unix_timestamp("begin"))
    return every.select(key, "hour", F.when(filled, F.col("v") + (F.col("next.v") - F.col("v")) * share).otherwise(F.col("v")).alias("v"), filled.alias("filled"))


def sliding_windows(series: DataFrame, key: str, context: int, horizon: int, stride: int) -> DataFrame:
    """Windows of context + horizon consecutive rows, a window each stride rows: their first time, context and horizon arrays."""
    order = Window.partitionBy(key).orderBy("ts")
    whole = F.collect_list("v").over(order.rowsBetween(0, context + horizon - 1))
    windows = series.withColumn("i", F.row_number().over(order) - 1).withColumn("w", whole)
    full = windows.where((F.size("w") == context + horizon) & (F.col("i") % stride == 0))
    return full.select(key, F.col("i").cast("long").alias("i"), "ts", F.slice("w", 1, context).alias("context"), F.slice("w", context + 1, horizon).alias("horizon"))


def chronological_split(series: DataFrame, key: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Rows by position in time: the first share trains, the next validates, the rest tests; shares are cut down to whole rows."""
    group = Window.partitionBy(key)
    i, n = F.row_number().over(group.orderBy("ts")) - 1, F.count("*").over(group)
    first, second = F.floor(n * train), F.floor(n * train) + F.floor(n * validation)
    return series.withColumn("split", F.when(i < first, "train").when(i < second, "validation").otherwise("test"))


def zscore(series: DataFrame, key: str) -> DataFrame:
    """(v - mean) / (population standard deviation + 1e-6)."""
    group = Window.partitionBy(key)
    return series.withColumn("z", (F.col("v") - F.avg("v").over(group)) / (F.stddev_pop("v").over(group) + 1e-6))


def persistence_error(series: DataFrame, key: str, horizon: int) -> DataFrame:
    """Mean absolute and root mean square error of the forecast that nothing changes for `horizon` rows."""
    then = F.lag("v", horizon).over(Window.partitionBy(key).orderBy("ts"))
    error = series.withColumn("e", F.col("v") - then).where("e IS NOT NULL")
    return error.groupBy(key).agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("*").alias("n"))


def peak(series: DataFrame, key: str, step_minutes: int, gate: float) -> DataFrame:
    """The value with the largest magnitude (the first on ties), how far ahead it is, and whether it passes the gate."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("ts"))
    numbered = series.withColumn("i", i)
    best = numbered.groupBy(key).agg(F.max_by(F.struct("v", "i"), F.struct(F.abs("v"), -F.col("i"))).alias("p"))
    return best.select(key, F.col("p.v").alias("peak"), (F.col("p.i") * step_minutes).cast("long").alias("minutes_ahead"), (F.abs("p.v") >= gate).alias("emitted"))


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Stretches of consecutive rows with one value: first and last place and number of rows."""
    by = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(value).over(by) != F.col(value)).cast("int"), F.lit(1))
    marked = df.withColumn("run", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, within_s: int, most: int = 1) -> DataFrame:
    """left_id, right_id, delta_s: the nearest rows of the right in time within a bound; the earlier one on ties.

    Rows meet by time bucket (the bound wide; the left looks at three), so that a key with many rows is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / within_s).cast("long")
    l = left.select(key, F.col("id").alias("left_id"), F.col("ts").alias("left_ts"), F.explode(F.array(*[bucket("ts") + d for d in (-1, 0, 1)])).alias("b"))  # noqa: E741
    r = right.select(key, F.col("id").alias("right_id"), F.col("ts").alias("right_ts"), bucket("ts").alias("b"))
    delta = F.abs(F.unix_micros(F.col("left_ts").cast("timestamp")) - F.unix_micros(F.col("right_ts").cast("timestamp"))) / 1e6
    met = l.join(r, [key, "b"]).withColumn("delta_s", delta).where(F.col("delta_s") <= within_s)
    order = Window.partitionBy("left_id").orderBy("delta_s", "right_ts", "right_id")
    return met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select(key, "left_id", "right_id", "delta_s", "rank")
