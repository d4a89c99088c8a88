"""Spatial joins of tables of points, boxes, polygons and grid cells.

Radius joins carry equi-keys: cells of a grid around the earth whose height is the radius and whose width grows with latitude, so that all
partners of a point lie in its own or an adjacent cell. Catalyst then picks a hash or sort-merge join and AQE splits hot cells;
no pair is compared that shares no cell. Tables have id, lat, lon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import new_path


def _band(lat: Column, height: float) -> Column:
    return F.floor(lat / height).cast("long")


def _columns(band: Column, height: float) -> Column:
    """Number of cells around the earth in a band: none narrower than the radius at the latitude a band farther out."""
    far = F.greatest(F.abs(band - 1), F.abs(band + 2)) * height
    width = F.lit(height) / F.greatest(F.cos(F.radians(F.least(far, F.lit(89.99)))), F.lit(1e-3))
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * columns).cast("long"), columns)


def near_join(queries: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """All columns of both (lat, lon as q_lat, q_lon and f_lat, f_lon) and distance_m of all pairs within the radius, edges included.
    Rows without coordinates have no partner. The join shuffles: what is told apart by cells is larger than Catalyst takes it for."""
    height = radius_m / 110_000.0
    f = features.where("lat IS NOT NULL AND lon IS NOT NULL").withColumnsRenamed({"lat": "f_lat", "lon": "f_lon"}).withColumn("cy", _band(F.col("f_lat"), height))
    f = f.withColumn("cx", _column(F.col("f_lon"), _columns(F.col("cy"), height)))
    q = queries.where("lat IS NOT NULL AND lon IS NOT NULL").withColumnsRenamed({"lat": "q_lat", "lon": "q_lon"}).withColumn("qy", _band(F.col("q_lat"), height))
    q = q.withColumn("cy", F.explode(F.array(F.col("qy") - 1, F.col("qy"), F.col("qy") + 1))).drop("qy")
    n = _columns(F.col("cy"), height)
    own = _column(F.col("q_lon"), n)
    q = q.withColumn("cx", F.explode(F.array_distinct(F.array(F.pmod(own - 1, n), own, F.pmod(own + 1, n)))))
    distance = geo.haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("f_lat"), F.col("f_lon"))
    return q.hint("merge").join(f, ["cy", "cx"]).withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m).drop("cy", "cx")


def radius_join(queries: DataFrame, features: DataFrame, radius_m: float, left: str = "query_id", right: str = "feature_id") -> DataFrame:
    """(left, right, distance_m) of all pairs within the radius, edges included. Rows without coordinates have no partner."""
    own = lambda df, name: df.select(F.col("id").alias(name), "lat", "lon")
    return near_join(own(queries, left), own(features, right), radius_m).select(left, right, "distance_m")


# Rows at one place have the same partners: what asks for sums and firsts only joins places, and folds rows of a place before.
def places(points: DataFrame, *folds: Column) -> DataFrame:
    """lat, lon of each place of the points, once, with folds of its rows."""
    at = points.where("lat IS NOT NULL AND lon IS NOT NULL")
    return at.groupBy("lat", "lon").agg(*folds) if folds else at.select("lat", "lon").distinct()


def radius_fold(queries: DataFrame, features: DataFrame, radius_m: float, local: list[Column], folds: list[Column]) -> DataFrame:
    """q_lat, q_lon and folds over the places of features within the radius of each place of the queries; `local` folds the features of a place."""
    return near_join(places(queries), places(features, *local), radius_m).groupBy("q_lat", "q_lon").agg(*folds)


def back(points: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """The points with what was found for their places (q_lat, q_lon)."""
    return points.join(found, (points.lat == found.q_lat) & (points.lon == found.q_lon), how).drop("q_lat", "q_lon")


def nearest_n(queries: DataFrame, features: DataFrame, n: int, radius_m: float, steps: tuple[int, ...] = (16, 4, 1)) -> DataFrame:
    """q_lat, q_lon, feature_id, distance_m, rank: of each place of the queries the n nearest features within the radius, by distance and id.

    Radii grow to the whole one: a place with n features within a part of it is done, so that it meets few of them where they are dense.
    Of the features at one place only the n smallest ids can be among the nearest.
    """
    first = top_n(features.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("feature_id"), "lat", "lon"), ["lat", "lon"], [F.col("feature_id")], n).drop("rank")
    first = _stored(first, "features")
    left, done = _stored(places(queries), "places"), []
    for step in steps:
        met = near_join(left, first, radius_m / step).select("q_lat", "q_lon", "feature_id", "distance_m")
        best = _stored(top_n(met, ["q_lat", "q_lon"], [F.col("distance_m"), F.col("feature_id")], n), "nearest")
        if step != steps[-1]:
            full = best.where(F.col("rank") == n).select("q_lat", "q_lon")
            best = best.join(full, ["q_lat", "q_lon"], "left_semi")
            left = _stored(left.join(full, (left.lat == full.q_lat) & (left.lon == full.q_lon), "left_anti"), "places")
        done.append(best)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


#: Cells of a level of the pyramid have 1 / SPLIT of the height and width of those above; the last ones are some 700 m high.
SPLIT, LEVELS = 8, 6


def _cell(lat: Column, lon: Column, level: int) -> Column:
    """The number of the cell of a level that holds a point: rows of equal height, each with equally many columns."""
    n = SPLIT**level
    row = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1)).cast("long")
    return row * n + F.least(F.floor((F.pmod(lon + 180, F.lit(360.0))) / 360 * n), F.lit(n - 1)).cast("long")


def _bounds(level: int) -> tuple[Column, Column]:
    """The distance from q_lat, q_lon to the middle of `cell`, and a bound of that from the middle to any of its points."""
    n = SPLIT**level
    lat = (F.floor(F.col("cell") / n) + 0.5) * (180.0 / n) - 90
    lon = (F.col("cell") % n + 0.5) * (360.0 / n) - 180
    widest = F.cos(F.radians(F.greatest(F.abs(lat) - 90.0 / n, F.lit(0.0))))
    reach = geo.EARTH_RADIUS_M * (F.radians(F.lit(90.0 / n)) + F.radians(F.lit(180.0 / n)) * widest)
    return F.nanvl(geo.haversine_m(F.col("q_lat"), F.col("q_lon"), lat, lon), F.lit(math.pi * geo.EARTH_RADIUS_M)), reach


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_any(queries: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """query_id, feature_id, distance_m of the nearest feature at any distance; the smaller id on ties.

    A place with a feature within the radius is done by joins of growing radii. The others walk down a pyramid of cells that hold features:
    at each level they keep those that can hold the nearest one, by bounds of the distance to any point of a cell, and go on to
    their children. So a place meets the features of few small cells, however far they are and however many others there are.
    """
    asking = queries.select(F.col("id").alias("query_id"), "lat", "lon")
    told = lambda found: back(asking, found, "inner").select("query_id", "feature_id", "distance_m")
    near = _stored(nearest_n(queries, features, 1, radius_m).drop("rank"), "near")
    spots = places(queries)
    left = spots.join(near, (spots.lat == near.q_lat) & (spots.lon == near.q_lon), "left_anti")
    at = _stored(left.select(F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), F.lit(0).cast("long").alias("up")), "left")
    if at.isEmpty():
        return told(near)
    features = places(features, F.min("id").alias("id"))
    placed = features.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias("feature_id"), "lat", "lon", _cell(F.col("lat"), F.col("lon"), LEVELS).alias("cell"))
    # The cells that hold features, stored once at the lowest level; each level above comes from the one below.
    levels = {LEVELS: _stored(placed.select("cell").distinct(), "cells")}
    up = lambda level: F.floor(F.floor(F.col("cell") / SPLIT**level) / SPLIT) * SPLIT ** (level - 1) + F.floor(F.col("cell") % SPLIT**level / SPLIT)
    for level in range(LEVELS, 1, -1):
        levels[level - 1] = levels[level].select(up(level).alias("cell")).distinct()
    for level in range(1, LEVELS + 1):
        cells = levels[level].withColumn("up", up(level))
        if level <= 2:
            cells = F.broadcast(cells)  # 4,096 cells at most
        middle, reach = _bounds(level)
        met = at.join(cells, "up").withColumn("d", middle).withColumn("reach", reach)
        least = F.min(F.col("d") + F.col("reach")).over(Window.partitionBy("q_lat", "q_lon"))
        at = met.withColumn("least", least).where(F.col("d") - F.col("reach") <= F.col("least") * (1 + 1e-9) + 1e-3).select("q_lat", "q_lon", F.col("cell").alias("up"))
    last = at.join(placed.withColumnRenamed("cell", "up"), "up").withColumn("distance_m", geo.haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")))
    far = last.groupBy("q_lat", "q_lon").agg(F.min(F.struct("distance_m", "feature_id")).alias("b")).select("q_lat", "q_lon", "b.feature_id", "b.distance_m")
    return told(near.unionByName(far))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def nearest_of(stations: list[tuple], k: int = 1) -> Column:
    """struct(d, ord, station) of the nearest of a short, fixed list of (name, lat, lon) to a row's lat, lon, or the k nearest; ties go to the first."""
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("station"), F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for i, (n, a, o) in enumerate(stations)])
    measured = F.transform(listed, lambda s: F.struct(geo.haversine_m(F.col("lat"), F.col("lon"), s.lat, s.lon).alias("d"), s.ord.alias("ord"), s.station.alias("station")))
    return F.array_min(measured) if k == 1 else F.slice(F.array_sort(measured), 1, k)


def nearest(queries: DataFrame, stations: list[tuple], k: int = 1) -> DataFrame:
    """query_id, station, distance_km of the nearest of a short, fixed list of (name, lat, lon); ties go to the first."""
    first = F.array(nearest_of(stations)) if k == 1 else nearest_of(stations, k)
    return queries.select(F.col("id").alias("query_id"), F.explode(first).alias("s")).select("query_id", F.col("s.station").alias("station"), (F.col("s.d") / 1000).alias("distance_km"))


def box_join(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """point_id, box_id of all points in boxes (id, min_lat, max_lat, min_lon, max_lon); boxes are dealt to the grid cells they touch."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    b = boxes.withColumnRenamed("id", "box_id").withColumn("cy", F.explode(F.sequence(at("min_lat"), at("max_lat")))).withColumn("cx", F.explode(F.sequence(at("min_lon"), at("max_lon"))))
    p = points.withColumnRenamed("id", "point_id").withColumn("cy", at("lat")).withColumn("cx", at("lon"))
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    return p.hint("merge").join(b, ["cy", "cx"]).where(inside)  # boxes dealt to cells are larger than Catalyst takes them for


def polygon_join(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Rows of box_join whose point lies in the polygon's `rings` (x: longitude, y: latitude)."""
    return box_join(points, polygons, cell).where(geo.point_in_rings(F.col("lon"), F.col("lat"), F.col("rings")))


def place_classes(points: DataFrame, shapes: DataFrame, cell: float, holds: Column) -> DataFrame:
    """q_lat, q_lon, the largest class of the shapes that hold each place of the points, and their number (`zones`).

    shapes: columns of box_join, class, and others that `holds`, the test of a place (lat, lon), needs; shapes alike count as often as they
    occur, but are met once. Boxes are candidates only: they are widened a little, so that `holds` alone decides on edges.
    """
    alike = shapes.drop("id").groupBy(*[c for c in shapes.columns if c != "id"]).agg(F.count("*").alias("copies"))
    for side, sign in (("min_lat", -1), ("max_lat", 1), ("min_lon", -1), ("max_lon", 1)):
        alike = alike.withColumn(side, F.col(side) + sign * 1e-9)
    met = box_join(places(points), alike, cell).where(holds)
    return met.groupBy(F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).agg(F.max("class").alias("class"), F.sum("copies").alias("zones"))


def max_class(points: DataFrame, found: DataFrame) -> DataFrame:
    """point_id and the largest class of the shapes that hold its place; 0 outside all of them."""
    return back(points, found).select(F.col("id").alias("point_id"), F.coalesce("class", F.lit(0)).cast("long").alias("class"))


def cell_lookup(points: DataFrame, cells: DataFrame, origin_lat: float, origin_lon: float, size: float, outside: float = 0.0) -> DataFrame:
    """id and value of the raster cell (row, col, value) of each point; `outside` beyond the raster."""
    row, col = geo.raster_cell(F.col("lat"), F.col("lon"), origin_lat, origin_lon, size)
    at = points.select("id", row.alias("row"), col.alias("col"))
    return at.join(cells, ["row", "col"], "left").select("id", "row", "col", F.coalesce("value", F.lit(outside)).alias("value"))


def route(points: DataFrame, regions: list[tuple]) -> DataFrame:
    """id and the region (name, min_lon, min_lat, max_lon, max_lat) that holds each point: the first by name, or none."""
    choice = F.coalesce(*[F.when(geo.within(F.col("lat"), F.col("lon"), *r[1:]), F.lit(r[0])) for r in sorted(regions)], F.lit("none"))
    return points.select("id", choice.alias("region"))
