"""Queries on time series: the events as sensors, their daily and hourly series, residuals, windows and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from .tables import load, series


def _events(spark, sf):
    return series(load(spark, sf, "events"))


def _hour(spark, sf):
    """Hourly means by user, as a series."""
    return ts.hourly(_events(spark, sf), "user_id").select("user_id", F.col("hour").alias("ts"), "v")


HOURS = "(SELECT user_id, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL)"


def residual_aligned(spark, sf):
    """Hourly means of clicks against those of views, where both exist: the last five of each user."""
    e = _events(spark, sf)
    part = lambda k: ts.hourly(e.where(F.col("event_type") == k), "user_id").select("user_id", F.col("hour").alias("ts"), "v")
    out = ts.aligned_residual(part("click"), part("view"), "user_id", 5)
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), *[F.round(c, 9).alias(c) for c in ("observed", "predicted", "residual")])


RESIDUAL = """
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts, avg(value) FILTER (event_type = 'click') AS o, avg(value) FILTER (event_type = 'view') AS p FROM events GROUP BY ALL)
SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(o, 9) AS observed, round(p, 9) AS predicted, round(o - p, 9) AS residual FROM h WHERE o IS NOT NULL AND p IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5"""


def hourly_floor_join(spark, sf):
    """Each purchase against the mean view of its hour; purchases without one are left out."""
    e = _events(spark, sf)
    views = ts.hourly(e.where("event_type = 'view'"), "user_id").withColumnRenamed("v", "mean_view")
    bought = e.where("event_type = 'purchase'").withColumn("hour", F.date_trunc("hour", "ts"))
    return bought.join(views, ["user_id", "hour"], "left").where("mean_view IS NOT NULL").select("id", "user_id", F.round(F.col("v") - F.col("mean_view"), 9).alias("residual"))


FLOOR_JOIN = """
SELECT event_id AS id, e.user_id, round(value - m, 9) AS residual FROM events e JOIN (SELECT user_id, date_trunc('hour', ts) AS h, avg(value) AS m FROM events WHERE event_type = 'view' GROUP BY ALL) v
ON v.user_id = e.user_id AND v.h = date_trunc('hour', e.ts) WHERE event_type = 'purchase'"""


def daily_zero_fill(spark, sf):
    """Flood events of each sensor and day, zeros included."""
    out = ts.daily_counts(_events(spark, sf), "user_id", F.col("event_type") == "error")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


_LAST = "(SELECT CAST(max(ts) AS DATE) FROM events)"
_CALENDAR = f"(SELECT user_id, CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), {_LAST}, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events))"
_DAILY = f"(SELECT c.user_id, c.day, count(e.event_id) AS n FROM {_CALENDAR} c LEFT JOIN events e ON e.user_id = c.user_id AND CAST(e.ts AS DATE) = c.day AND event_type = 'error' GROUP BY ALL)"
ZERO_FILL = f"SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n FROM {_DAILY}"


def daily_summary(spark, sf):
    """Of each sensor's daily counts: days with events, sum, mean, best day, the last week and the one before, and whether events accelerate."""
    e = _events(spark, sf)
    last = F.broadcast(e.agg(F.max(F.to_date("ts")).alias("last")))  # one row
    d = ts.daily_counts(e, "user_id", F.col("event_type") == "error").join(last).withColumn("ago", F.date_diff("last", "day"))
    best = F.max_by("day", F.struct(F.col("n"), -F.unix_date("day")))
    recent, before = F.sum(F.when(F.col("ago") < 7, F.col("n")).otherwise(0)), F.sum(F.when(F.col("ago").between(7, 13), F.col("n")).otherwise(0))
    out = d.groupBy("user_id").agg(F.count_if(F.col("n") > 0).alias("days_with"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.date_format(best, "yyyy-MM-dd").alias("best_day"), recent.alias("recent"), before.alias("before"))
    return out.withColumn("accelerating", (F.col("before") > 0) & (F.col("recent") > 1.5 * F.col("before")))


SUMMARY = f"""
SELECT *, before > 0 AND recent > 1.5 * before AS accelerating FROM (
  SELECT user_id, count(*) FILTER (n > 0) AS days_with, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, max(n) AS most, strftime(first(day ORDER BY n DESC, day), '%Y-%m-%d') AS best_day,
  CAST(coalesce(sum(n) FILTER ({_LAST} - day < 7), 0) AS BIGINT) AS recent, CAST(coalesce(sum(n) FILTER ({_LAST} - day BETWEEN 7 AND 13), 0) AS BIGINT) AS before FROM {_DAILY} GROUP BY user_id)"""


def resample_interpolate(spark, sf):
    """Hourly means without gaps: how many hours were filled, and the mean of all, by user."""
    out = ts.interpolated(_events(spark, sf), "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("hours"), F.count_if("filled").alias("filled"), F.round(F.avg("v"), 6).alias("mean"))


INTERPOLATE = f"""
WITH h AS {HOURS}, c AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY user_id),
j AS (SELECT c.user_id, c.ts, v, last_value(CASE WHEN v IS NOT NULL THEN c.ts END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN c.ts END IGNORE NULLS) OVER q AS t1, first_value(v IGNORE NULLS) OVER q AS v1 FROM c LEFT JOIN h ON h.user_id = c.user_id AND h.ts = c.ts
  WINDOW p AS (PARTITION BY c.user_id ORDER BY c.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY c.user_id ORDER BY c.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, count(*) AS hours, count(*) FILTER (v IS NULL) AS filled, round(avg(coalesce(v, v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)))), 6) AS mean FROM j GROUP BY user_id"""


def sliding_windows(spark, sf):
    """Windows of eight hourly means and the two that follow, every fourth hour: number and sums."""
    out = ts.sliding_windows(_hour(spark, sf), "user_id", 8, 2, 4)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("user_id").agg(F.count("*").alias("windows"), F.round(F.sum(total("context")), 6).alias("context"), F.round(F.sum(total("horizon")), 6).alias("horizon"))


SLIDING = f"""
WITH w AS (SELECT user_id, row_number() OVER o - 1 AS i, list(v) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM {HOURS} WINDOW o AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, count(*) AS windows, round(sum(list_sum(w[1:8])), 6) AS context, round(sum(list_sum(w[9:10])), 6) AS horizon FROM w WHERE len(w) = 10 AND i % 4 = 0 GROUP BY user_id"""


def chronological_split(spark, sf):
    """Rows of each split of the hourly series, by user."""
    return ts.chronological_split(_hour(spark, sf), "user_id").groupBy("user_id", "split").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))


SPLIT = f"""
WITH r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {HOURS})
SELECT user_id, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(avg(v), 9) AS mean FROM r GROUP BY ALL"""


def zscore(spark, sf):
    """Standardised values of the events of each user: the extremes."""
    return ts.zscore(_events(spark, sf), "user_id").groupBy("user_id").agg(F.round(F.min("z"), 9).alias("least"), F.round(F.max("z"), 9).alias("most"))


ZSCORE = """
SELECT user_id, round(min(z), 9) AS least, round(max(z), 9) AS most FROM (
  SELECT user_id, (value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-6) AS z FROM events) GROUP BY user_id"""


def persistence(spark, sf):
    """Errors of the forecast that the hourly mean stays, two hours ahead."""
    out = ts.persistence_error(_hour(spark, sf), "user_id", 2)
    return out.select("user_id", F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"), "n")


PERSISTENCE = f"""
SELECT user_id, round(avg(abs(e)), 9) AS mae, round(sqrt(avg(e * e)), 9) AS rmse, count(*) AS n FROM (SELECT user_id, v - lag(v, 2) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM {HOURS}) WHERE e IS NOT NULL GROUP BY user_id"""


def peak_abs(spark, sf):
    """The hour whose mean is farthest from 50, by user."""
    s = _hour(spark, sf).withColumn("v", F.round(F.col("v") - 50, 6))
    return ts.peak(s, "user_id", 60, 30.0).select("user_id", F.round("peak", 9).alias("peak"), "minutes_ahead", "emitted")


PEAK = f"""
WITH s AS (SELECT user_id, round(v - 50, 6) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM {HOURS})
SELECT user_id, round(first(v ORDER BY abs(v) DESC, i), 9) AS peak, first(i ORDER BY abs(v) DESC, i) * 60 AS minutes_ahead, max(abs(v)) >= 30 AS emitted FROM s GROUP BY user_id"""


def asof_nearest(spark, sf):
    """The view nearest in time to each purchase of the same user, within six hours."""
    e = _events(spark, sf)
    out = ts.nearest_in_time(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 6 * 3600)
    return out.select("left_id", "right_id", F.round("delta_s", 3).alias("delta_s"))


ASOF = """
WITH j AS (SELECT a.event_id AS left_id, b.event_id AS right_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 AS d, b.ts AS t FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view')
SELECT left_id, right_id, round(d, 3) AS delta_s FROM j WHERE d <= 21600 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY d, t, right_id) = 1"""


def run_envelope(spark, sf):
    """Stretches of equal event types of each user: the longest."""
    return ts.runs(_events(spark, sf), "user_id", "id", "event_type").groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


RUNS = """
WITH g AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g, event_type FROM events),
r AS (SELECT user_id, event_type, g, count(*) AS n FROM g GROUP BY ALL) SELECT user_id, count(*) AS runs, max(n) AS longest FROM r GROUP BY user_id"""


def session_windows(spark, sf):
    """Sessions of each user with gaps under six hours: how many, and the longest in events."""
    s = _events(spark, sf).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SESSIONS = """
WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"""

QUERIES = {
    "residual_aligned": (residual_aligned, RESIDUAL), "hourly_floor_join": (hourly_floor_join, FLOOR_JOIN), "daily_zero_fill": (daily_zero_fill, ZERO_FILL), "daily_summary": (daily_summary, SUMMARY),
    "resample_interpolate": (resample_interpolate, INTERPOLATE), "sliding_windows": (sliding_windows, SLIDING), "chronological_split": (chronological_split, SPLIT), "zscore": (zscore, ZSCORE),
    "persistence_error": (persistence, PERSISTENCE), "peak_abs": (peak_abs, PEAK), "asof_nearest": (asof_nearest, ASOF), "run_envelope": (run_envelope, RUNS), "session_windows": (session_windows, SESSIONS),
}
