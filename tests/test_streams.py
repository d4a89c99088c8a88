"""Streams in append mode: files that arrive in several runs, a restart from the checkpoint, closing by the watermark, late rows, users that expire."""

from datetime import datetime, timedelta

import pytest
from compare import difference
from pyspark.sql import functions as F

from evigrid import registry
from evigrid.streaming import events as streams

START = datetime(2024, 3, 1)


def arrive(spark, folder, rows):
    """rows: (event_id, hours after START, user, value)"""
    spark.createDataFrame([(i, START + timedelta(hours=h), u, "view", v, None) for i, h, u, v in rows], streams.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(df, folder, name):
    query = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_days_close_once_and_late_rows_are_counted(spark, tmp_path):
    folder = f"file://{tmp_path}"
    arrive(spark, f"{folder}/in", [(1, 1, 7, 1.0), (2, 30, 7, 2.0)])
    streams.tick(spark, f"{folder}/clock", START)
    source = lambda: streams.daily(streams.with_clock(streams.read(spark, f"{folder}/in"), f"{folder}/clock"), "1 hour")
    told = lambda: sorted((r.day, r.user_id, r.n, r.peak) for r in spark.read.parquet(f"{folder}/daily").collect() if r.user_id is not None)
    run(source(), folder, "daily")
    assert told() == [(START, 7, 1, 1.0)]  # the second day is still open
    arrive(spark, f"{folder}/in", [(3, 2, 7, 9.0), (4, 31, 7, 5.0), (5, 100, 8, 3.0)])  # the first comes after its day has closed
    query = run(source(), folder, "daily")
    assert streams.late_rows(query) == 1
    assert told() == [(START, 7, 1, 1.0), (START + timedelta(days=1), 7, 2, 5.0)]
    streams.tick(spark, f"{folder}/clock", START + timedelta(days=30))
    run(source(), folder, "daily")
    assert told() == [(START, 7, 1, 1.0), (START + timedelta(days=1), 7, 2, 5.0), (START + timedelta(days=4), 8, 1, 3.0)]


def test_users_expire(spark, tmp_path):
    folder = f"file://{tmp_path}"
    arrive(spark, f"{folder}/in", [(1, 0, 1, 1.0), (2, 0, 1, None), (3, 1, 2, 4.0)])
    streams.tick(spark, f"{folder}/clock", START)
    source = lambda: streams.peaks(streams.with_clock(streams.read(spark, f"{folder}/in"), f"{folder}/clock"), 10 * 3_600_000, "1 hour")
    told = lambda: sorted((r.user_id, r.kind, r.peak, r.n, tuple(r.risen)) for r in spark.read.parquet(f"{folder}/peaks").collect())
    run(source(), folder, "peaks")
    first = [(1, "risen", 1.0, 2, (1.0,)), (2, "risen", 4.0, 1, (4.0,))]
    assert told() == first
    arrive(spark, f"{folder}/in", [(4, 5, 2, 3.0), (5, 6, 2, 7.0)])  # user 2 stays, and rises
    run(source(), folder, "peaks")
    second = [*first, (2, "risen", 7.0, 3, (4.0, 7.0))]
    assert told() == sorted(second)
    streams.tick(spark, f"{folder}/clock", START + timedelta(hours=13))  # the watermark passes 10 hours after user 1's last event
    run(source(), folder, "peaks")
    assert told() == sorted([*second, (1, "closed", 1.0, 2, (1.0,))])
    arrive(spark, f"{folder}/in", [(6, 14, 1, 0.5)])  # back with a new state
    run(source(), folder, "peaks")
    assert (1, "risen", 0.5, 1, (0.5,)) in told()
    streams.tick(spark, f"{folder}/clock", START + timedelta(days=9))
    run(source(), folder, "peaks")
    assert {r for r in told() if r[1] == "closed"} == {(1, "closed", 1.0, 2, (1.0,)), (2, "closed", 7.0, 3, (4.0, 7.0)), (1, "closed", 0.5, 1, (0.5,))}


@pytest.mark.parametrize("name", ["stream_peaks", "stream_daily"])
def test_files_in_any_order_lose_no_event(spark, tmp_path, name):
    folder = f"file://{tmp_path}/events.parquet"
    for i in range(13):  # more files than two batches read, the first ones with the latest events
        arrive(spark, folder, [(2 * i + j, 24 * (20 - i) + 7 * j, i % 6 + 6 * j, float(i)) for j in range(2)])
    assert difference(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_rows_of_a_user_are_folded_before_its_state(spark):
    nan = float("nan")
    rows = [(i, START + timedelta(hours=i), i % 3, "view", None if i % 3 == 2 else nan if i == 4 else float(i), None) for i in range(30)]
    events = spark.createDataFrame(rows, streams.SCHEMA).coalesce(1)
    got = {r.user_id: (r.ts, r.value, r.n) for r in streams.folded(events).collect()}
    assert len(got) == 3 and got[0] == (START + timedelta(hours=27), 27.0, 10) and got[2] == (START + timedelta(hours=29), None, 10)
    assert got[1][1] != got[1][1] and got[1][2] == 10
    many = events.crossJoin(spark.range(7).withColumnRenamed("id", "k")).repartition(3)
    assert streams.folded(many).agg(F.sum("n")).first()[0] == 210 and streams.folded(many).count() <= 9
