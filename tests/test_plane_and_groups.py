"""The plane and back; centroids of rings; row groups by ranges of keys."""

import math

from pyspark.sql import functions as F

from evigrid.functions import geo
from evigrid.sources import rowgroups, shared


def test_projection_and_back(spark):
    places = [(40.2 + i * 0.13, -75.5 + i * 0.21) for i in range(16)] + [(40 + 10 / 60, -74.0), (0.5, -74.0), (60.0, -20.0), (None, -74.0)]
    x, y = geo.lambert_feet(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_lambert_feet(F.col("x"), F.col("y"))
    rows = spark.createDataFrame(places, "lat double, lon double").select("lat", "lon", x.alias("x"), y.alias("y")).select("*", lat.alias("back_lat"), lon.alias("back_lon")).collect()
    assert all(abs(r.lat - r.back_lat) < 1e-9 and abs(r.lon - r.back_lon) < 1e-9 for r in rows[:-1]) and rows[-1].back_lat is None
    origin = rows[16]
    assert math.isclose(origin.x, 300_000 * 3937 / 1200, rel_tol=1e-12) and abs(origin.y) < 1e-6


def test_centroids(spark):
    cases = [
        ([(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)], (2, 1)), ([(0, 0), (0, 3), (3, 0), (0, 0)], (1, 1)), ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2), (0, 0)], (14 / 6, 10 / 6)),
        ([(1, 1), (3, 3), (1, 1)], (2, 2)), ([(5, 6)], (5, 6)), ([], (None, None)), (None, (None, None)),
    ]
    for shift in (0, 1e6):
        rows = [(None if r is None else [(float(x + shift), float(y - shift)) for x, y in r],) for r, _ in cases]
        x, y = geo.ring_centroid(F.col("ring"))
        got = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>").select(x.alias("x"), y.alias("y")).collect()
        for r, (_, want) in zip(got, cases):
            assert (r.x is None) == (want[0] is None) and (want[0] is None or (math.isclose(r.x, want[0] + shift, abs_tol=1e-6) and math.isclose(r.y, want[1] - shift, abs_tol=1e-6)))


def test_row_groups(spark):
    path = shared.new_path(spark, "groups")
    table = spark.range(20_000).selectExpr("(id * 7919) % 5000 AS k", "id AS v", "'x' AS unused").unionByName(spark.createDataFrame([(None, 1, "n")], "k long, v long, unused string"))
    rowgroups.write_clustered(table, "k", path, 500, 4)
    groups = rowgroups.index(spark, path, "k").cache()
    assert groups.agg(F.sum("n")).first()[0] == 20_001 and groups.count() >= 20
    wanted = spark.createDataFrame([(5,), (6,), (4321,), (99_999,), (None,), (5,)], "k long")
    for cell in (1, 100, 10_000):
        picked = rowgroups.chosen(groups, wanted, "k", cell).agg(F.sum("n")).first()[0]
        assert picked <= 3000
        got = sorted(tuple(r) for r in rowgroups.read(groups, wanted, "k", "k long, v long", cell).collect())
        assert got == sorted((i * 7919 % 5000, i) for i in range(20_000) if i * 7919 % 5000 in (5, 6, 4321))
    assert rowgroups.read(groups, wanted.limit(0), "k", "k long, v long").count() == 0
