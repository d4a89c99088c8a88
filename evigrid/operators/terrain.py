"""Flow over a raster of heights (row, col, value): directions, accumulation, streams and heights above them, by joins.

Paths are followed by doubling: in each round a cell takes over where the cell it points to points, so that the longest path of
n cells takes log2(n) rounds, each a join stored in the shared folder. Heights are taken as they are: pits end their paths. All joins
are by shuffle: a broadcast in each round would send tables of cells through the driver again and again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = shared.new_path(spark, "terrain")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def directions(cells: DataFrame) -> DataFrame:
    """cell, row, col, value, to and drop: the neighbour with the steepest way down (the first by row and column of equals), and
    the height lost on a unit of it; null and 0 for pits and cells without a value."""
    key = lambda r, c: F.shiftleft(r.cast("long"), 32) + c
    z = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dy * dy + dx * dx) ** 0.5).alias("far")) for dy, dx in _AROUND])
    told = z.where("value IS NOT NULL").select("row", "col", "value", F.explode(offsets).alias("o"))
    told = told.select((F.col("row") + F.col("o.dy")).alias("row"), (F.col("col") + F.col("o.dx")).alias("col"), F.col("value").alias("near"), F.col("row").alias("r"), F.col("col").alias("c"), "o.far")
    fall = told.hint("merge").join(z, ["row", "col"]).withColumn("drop", (F.col("value") - F.col("near")) / F.col("far")).where("drop > 0")
    steepest = fall.groupBy("row", "col").agg(F.max_by(F.struct("r", "c", "drop"), F.struct("drop", -F.col("r"), -F.col("c"))).alias("s"))
    met = z.join(steepest.hint("merge"), ["row", "col"], "left")
    return met.select(key(F.col("row"), F.col("col")).alias("cell"), "row", "col", "value", F.when(F.col("s").isNotNull(), key(F.col("s.r"), F.col("s.c"))).alias("to"), F.coalesce("s.drop", F.lit(0.0)).alias("drop"))


def accumulation(flow: DataFrame) -> DataFrame:
    """cell and n: the cells whose path leads through each cell, itself included."""
    now = _stored(flow.select("cell", "to", F.lit(1).cast("long").alias("n")))
    while not now.where("to IS NOT NULL").isEmpty():
        # n counts the cells up to 2 ** k steps above; those that point here bring theirs, and point twice as far from now on.
        more = now.where("to IS NOT NULL").groupBy(F.col("to").alias("cell")).agg(F.sum("n").alias("more"))
        ahead = now.select(F.col("cell").alias("to"), F.col("to").alias("next"))
        now = _stored(now.join(more.hint("merge"), "cell", "left").join(ahead.hint("merge"), "to", "left").select("cell", F.col("next").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return now.select("cell", "n")


def ends(flow: DataFrame, stop: DataFrame) -> DataFrame:
    """cell and end: the first cell of `stop` (cell) on the path of each cell, itself included; the end of the path where there is none."""
    halted = flow.select("cell", "to").join(stop.select("cell", F.lit(True).alias("halt")).hint("merge"), "cell", "left")
    now = _stored(halted.select("cell", F.when(F.col("halt").isNull(), F.col("to")).alias("to")).select("cell", F.coalesce("to", "cell").alias("end")))
    while True:
        new = _stored(now.join(now.select(F.col("cell").alias("end"), F.col("end").alias("next")).hint("merge"), "end").select("cell", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("cell", "end")
        now = new.select("cell", "end")


def indices(cells: DataFrame, size_m: float, stream_cells: int) -> DataFrame:
    """row, col, n, stream (n of `stream_cells` or more), hand (height above the first stream cell on the way down; null where the
    path meets none) and twi (the log of the area drained by a unit of width over the slope) of each cell with a value."""
    flow = _stored(directions(cells.where("value IS NOT NULL")))
    n = _stored(accumulation(flow))
    streams = n.where(F.col("n") >= stream_cells)
    heights = flow.hint("merge").join(streams, "cell").select(F.col("cell").alias("end"), F.col("value").alias("bed"))
    hand = ends(flow, streams).hint("merge").join(heights, "end").select("cell", "bed")
    slope = F.greatest(F.col("drop") / size_m, F.lit(1e-3))
    met = flow.join(n.hint("merge"), "cell").join(hand.hint("merge"), "cell", "left")
    return met.select("row", "col", "n", (F.col("n") >= stream_cells).alias("stream"), (F.col("value") - F.col("bed")).alias("hand"), F.ln(F.col("n") * size_m / slope).alias("twi"))
