"""Structured Streaming forms of the event summaries: event time, watermarks, windows, sessions and state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """Events of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each user and day; days close once the watermark has passed them."""
    window = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(window, "user_id").agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(F.col("window.start").alias("day"), "user_id", "n", "peak")


def hourly_sliding(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Six-hour means of each user, every hour."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "6 hours", "1 hour"), "user_id").agg(F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "user_id", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user."""
    session = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(session, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, though files may repeat it within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_clock(events: DataFrame, clock: str) -> DataFrame:
    """The events, and those of a folder of their own whose only use is their time: a late one there moves the watermark past all
    windows of a stream that has ended. They have no user."""
    ticks = events.sparkSession.readStream.schema(SCHEMA).parquet(clock)
    return events.select(*ticks.columns).unionByName(ticks.withColumn("user_id", F.lit(None).cast("long")))


def tick(spark: SparkSession, clock: str, at: datetime) -> None:
    """Moves a clock on."""
    spark.createDataFrame([(None, at, None, None, None, None)], SCHEMA).write.mode("append").parquet(clock)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had closed, in the batches that the query remembers."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p["stateOperators"])


#: Rows of folded users that a task holds before it gives them on.
HELD = 200_000


def folded(events: DataFrame) -> DataFrame:
    """user_id, ts, value, n: the rows of each user that a task reads, as one row with their latest time, highest value and number.

    They arrive together: such a row is late only if its latest time is.
    """

    def once(rows: pa.Table) -> pa.Table:
        found = rows.group_by("user_id").aggregate([("ts", "max"), ("value", "max"), ("nan", "max"), ("n", "sum")])
        return pa.table({"user_id": found["user_id"], "ts": found["ts_max"], "value": found["value_max"], "nan": found["nan_max"], "n": found["n_sum"]})

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        value = pc.if_else(pc.equal(rows["nan"], 1), float("nan"), rows["value"])
        yield from rows.select(["user_id", "ts", "n"]).add_column(2, "value", value).to_batches(10_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            nan = pc.fill_null(pc.is_nan(batch["value"]), False).cast("int64")  # Arrow leaves not-a-number out of a maximum
            parts.append(once(pa.table({"user_id": batch["user_id"], "ts": batch["ts"], "value": batch["value"], "nan": nan, "n": pa.repeat(pa.scalar(1, pa.int64()), len(batch))})))
            size += len(parts[-1])
            if size > HELD:
                parts = [once(pa.concat_tables(parts))]
                size = len(parts[0])
                if size > HELD // 2:
                    yield from told(parts[0])
                    parts, size = [], 0
        if parts:
            yield from told(once(pa.concat_tables(parts)))

    return events.select("user_id", "ts", "value").mapInArrow(fold, "user_id long, ts timestamp, value double, n long")


PEAK_SCHEMA = "user_id long, kind string, peak double, n long, risen array<double>"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PeakProcessor(StatefulProcessor):
    """State of a user: peak, number of events, time of the last one, and the last KEPT peaks, in one value: each call of the state is a
    message to another process, and these take most of the time.

    A row "risen" is given for a batch in which the peak rises. With event time, a timer is set `idle_ms` after the user's last event: when the
    watermark reaches it, a row "closed" is given and the state goes. A timer that finds later events sets the next one, so that events move none.
    With processing time, the state has `ttl_ms` to live. Null values are none; not-a-number is above all others, as in SQL.
    """

    KEPT = 3

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "peak double, n long, last long, risen array<double>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known.get()
        peak, n, last, risen = known or (None, 0, -1, [])
        rose, latest = False, None
        for row in rows:
            n += row.n
            value, ts = row.value, row.ts
            if value is not None and (peak is None or value > peak or (value != value and peak == peak)):
                peak, rose = value, True
            if latest is None or ts > latest:
                latest = ts
        last = max(last, int(latest.timestamp() * 1000))
        risen = [*risen, peak][-self.KEPT :] if rose else risen
        self.known.update((peak, n, last, risen))
        if known is None and self.idle_ms is not None:
            self.handle.registerTimer(last + self.idle_ms)
        if rose:
            yield Row(user_id=key[0], kind="risen", peak=peak, n=n, risen=risen)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.known.get()
        if known is None:
            return
        peak, n, last, risen = known
        if last + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + self.idle_ms)
            return
        self.known.clear()
        yield Row(user_id=key[0], kind="closed", peak=peak, n=n, risen=risen)

    def close(self) -> None:
        pass


def peaks(events: DataFrame, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """PEAK_SCHEMA rows of each user, by event time: state goes when a user has been idle."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    # The time is named in the filter, so that it is not taken before the watermark: rows without a user move the watermark too.
    known = folded(events).withWatermark("ts", late).where("user_id IS NOT NULL OR ts < TIMESTAMP '0001-01-02 00:00:00'")
    return known.groupBy("user_id").transformWithState(PeakProcessor(idle_ms=idle_ms), PEAK_SCHEMA, "append", "eventTime")


def running_peak(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """After each batch: the users whose peak has risen, with the new peak; state is a few numbers a user.

    With `ttl_ms` the state of a user lives so long after its last change. It goes by the clock on the wall then: such a stream looks at the
    clock again and again, and does not end by itself when its input does.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    mode = "none" if ttl_ms is None else "processingTime"
    out = folded(events.where("user_id IS NOT NULL")).groupBy("user_id").transformWithState(PeakProcessor(ttl_ms=ttl_ms), PEAK_SCHEMA, "append", mode)
    return out.select("user_id", "peak", "n")
