"""Queries that run a stream over all events that are there, and return what its sink then holds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from ..streaming import events as streams


FILES_EACH = 4


def _run(spark, sf, name: str, stream: Callable[..., DataFrame]) -> DataFrame:
    """Runs a stream to the end of its input, its sink being a table that is only added to. Then a clock moves the watermark past all windows, and
    the stream is started again from its checkpoint, which closes them and lets their state go. Files come in any order of their events: where
    they are not all read at once, events may be late by the whole span of time, so that none is dropped."""
    path = shared.new_path(spark, name)
    clock = f"{path}-clock"
    streams.tick(spark, clock, datetime(1970, 1, 2))
    read = spark.readStream.schema(streams.SCHEMA).option("maxFilesPerTrigger", FILES_EACH).parquet(f"{sf}/events.parque[t]")  # a pattern: the table may be a file or a folder
    table = spark.read.parquet(f"{sf}/events.parquet")
    first, last = (at or datetime(1970, 1, 2) for at in table.agg(F.min("ts"), F.max("ts")).first())
    span = last - first + timedelta(days=1) if len(table.inputFiles()) > FILES_EACH else timedelta(0)
    out = stream(streams.with_clock(read, clock), **({"late": f"{span.days + 1} days"} if span else {}))
    for _ in range(2):
        writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
        writer.format("parquet").option("path", path).start().awaitTermination()
        streams.tick(spark, clock, last + span + timedelta(days=60))
    return spark.read.schema(out.schema).parquet(path).where("user_id IS NOT NULL" if "user_id" in out.columns else "true")


def stream_daily(spark, sf):
    """Events and peak of each user and day, by a stream with event time."""
    out = _run(spark, sf, "daily", streams.daily)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "peak")


DAILY = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2"


def stream_sliding(spark, sf):
    """Six-hour means of each user every hour, by a stream: windows, and the highest mean."""
    out = _run(spark, sf, "sliding", streams.hourly_sliding)
    return out.groupBy("user_id").agg(F.count("*").alias("windows"), F.round(F.max("mean"), 6).alias("highest"))


SLIDING = """
WITH w AS (SELECT user_id, date_trunc('hour', ts) - to_hours(k) AS start, avg(value) AS mean FROM events, (SELECT unnest(range(6)) AS k) GROUP BY ALL)
SELECT user_id, count(*) AS windows, round(max(mean), 6) AS highest FROM w GROUP BY user_id"""


def stream_sessions(spark, sf):
    """Sessions of each user with gaps of six hours, by a stream: how many, and the longest."""
    out = _run(spark, sf, "sessions", streams.sessions)
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SESSIONS = """
WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id"""


def stream_once(spark, sf):
    """Events that arrive twice, each kept once by a stream, by type."""
    out = _run(spark, sf, "once", lambda e, **late: streams.deduplicated(e.unionByName(e), **late))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


ONCE = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type"


def stream_peaks(spark, sf):
    """The highest value of each user, by a stream with state of its own that closes when a user has been idle for ten days after the end."""
    out = _run(spark, sf, "peaks", lambda e, **late: streams.peaks(e, 10 * 86_400_000, **late))
    return out.groupBy("user_id").agg(F.max("peak").alias("peak"))


PEAKS = "SELECT user_id, max(value) AS peak FROM events GROUP BY user_id"

QUERIES = {"stream_daily": (stream_daily, DAILY), "stream_sliding": (stream_sliding, SLIDING), "stream_sessions": (stream_sessions, SESSIONS), "stream_once": (stream_once, ONCE), "stream_peaks": (stream_peaks, PEAKS)}
