"""Inputs of the registered queries: tables, and coordinates derived from their keys (the tables have none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Boxes of regions as (name, min_lon, min_lat, max_lon, max_lat), and of the contiguous United States.
REGIONS = [
    ("albany", -73.90, 42.60, -73.72, 42.73), ("boston", -71.20, 42.23, -70.92, 42.40), ("chicago", -87.95, 41.64, -87.52, 42.02),
    ("nyc", -74.30, 40.49, -73.69, 40.92), ("seattle", -122.46, 47.49, -122.22, 47.74), ("sf", -122.52, 37.70, -122.35, 37.84),
]
CONUS = (-125.0, 24.5, -66.9, 49.4)
# Public stations as (id, lat, lon): tide gauges, weather stations, and the gauges that surges are forecast at.
TIDES = [
    ("8518750", 40.7006, -74.0142), ("8516945", 40.8103, -73.7649), ("8531680", 40.4669, -74.0094), ("8518995", 42.6469, -73.7464), ("8518962", 41.7569, -73.9433), ("8519483", 41.3845, -73.9536),
    ("8443970", 42.3548, -71.0534), ("9414290", 37.8063, -122.4659), ("9414750", 37.7717, -122.3000), ("9447130", 47.6026, -122.3392), ("9087044", 41.7300, -87.5383),
]
WEATHER = [
    ("KNYC", 40.7794, -73.9692), ("KLGA", 40.7794, -73.8800), ("KJFK", 40.6413, -73.7781), ("KEWR", 40.6925, -74.1687), ("KFRG", 40.7288, -73.4134), ("KHPN", 41.0670, -73.7076), ("KSWF", 41.5042, -74.1048),
    ("KPOU", 41.6262, -73.8842), ("KALB", 42.7475, -73.8025), ("KBOS", 42.3606, -71.0097), ("KBED", 42.4699, -71.2890), ("KORD", 41.9786, -87.9048), ("KMDW", 41.7868, -87.7522), ("KSEA", 47.4502, -122.3088),
    ("KBFI", 47.5300, -122.3019), ("KSFO", 37.6213, -122.3790), ("KOAK", 37.7213, -122.2208),
]
SURGE = TIDES[:3]
# Gauges of the Great Lakes, which have a datum of their own.
LAKES = ["9087044"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lat(key: str, shift: int) -> str:
    return f"(CAST(40.49 AS DOUBLE) + CAST((({key} + {shift}) * 7919) % 4300 AS DOUBLE) / CAST(10000 AS DOUBLE))"


def _lon(key: str, shift: int) -> str:
    return f"(CAST(-74.30 AS DOUBLE) + CAST((({key} + {shift}) * 104729) % 6100 AS DOUBLE) / CAST(10000 AS DOUBLE))"


def points(df: DataFrame, key: str, shift: int = 0, *more: str) -> DataFrame:
    """id, lat, lon and further columns of a table."""
    return df.selectExpr(f"CAST({key} AS BIGINT) AS id", f"{_lat(f'CAST({key} AS BIGINT)', shift)} AS lat", f"{_lon(f'CAST({key} AS BIGINT)', shift)} AS lon", *more)


def points_sql(table: str, key: str, shift: int = 0, more: str = "") -> str:
    return f"(SELECT CAST({key} AS BIGINT) AS id, {_lat(f'CAST({key} AS BIGINT)', shift)} AS lat, {_lon(f'CAST({key} AS BIGINT)', shift)} AS lon{', ' + more if more else ''} FROM {table})"


def haversine_sql(a: str, b: str) -> str:
    return (
        f"(2 * CAST(6371000 AS DOUBLE) * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def series(df: DataFrame) -> DataFrame:
    """user_id, ts, v, id of the events."""
    return df.select("user_id", "ts", F.col("value").alias("v"), F.col("event_id").alias("id"), "event_type")


#: Boxes around the parts' points; the half-widths keep edges off the points' lattice.
BOX = "CAST(p_size AS DOUBLE) / CAST(20000 AS DOUBLE) + CAST(0.00005 AS DOUBLE)"


def boxes(df: DataFrame) -> DataFrame:
    p = points(df, "p_partkey", 50000, "CAST(p_size % 3 + 1 AS BIGINT) AS class", f"{BOX} AS half")
    corner = lambda sx, sy: F.struct((F.col("lon") + sx * F.col("half")).alias("x"), (F.col("lat") + sy * F.col("half")).alias("y"))
    box, diamond = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], [(0, -1), (1, 0), (0, 1), (-1, 0), (0, -1)]
    ring = lambda at: F.array(*[corner(*c) for c in at])
    return p.select(
        "id", "class", "half", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), (F.col("lat") - F.col("half")).alias("min_lat"), (F.col("lat") + F.col("half")).alias("max_lat"),
        (F.col("lon") - F.col("half")).alias("min_lon"), (F.col("lon") + F.col("half")).alias("max_lon"), F.array(ring(diamond)).alias("rings"), ring(box).alias("box_ring"),
    )


BOXES_SQL = points_sql("part", "p_partkey", 50000, f"CAST(p_size % 3 + 1 AS BIGINT) AS class, {BOX} AS half")
