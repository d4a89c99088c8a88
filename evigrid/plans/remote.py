"""Queries on records read through the data source of ``sources.records``, from JSON lines in the shared folder; and on chosen row groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import rowgroups, shared
from ..sources.records import records
from .tables import load, points, points_sql

FIELDS = "id bigint, lat double, lon double, acctbal double, name string"
CENTRE, RADIUS, NEWEST = (40.7, -73.95), 9000.0, 25


def _published(spark, sf) -> str:
    """The customers with their places as JSON lines; returns the folder."""
    path = shared.new_path(spark, "published")
    points(load(spark, sf, "customer"), "c_custkey", 0, "CAST(c_acctbal AS DOUBLE) AS acctbal", "c_name AS name").write.json(path)
    return path


def records_in_circle(spark, sf):
    """Records within a circle with a balance, and names that end in 7: the circle and the balance are judged by the source, the names here."""
    found = records(spark, _published(spark, sf), FIELDS, circle=(*CENTRE, RADIUS))
    return found.where("acctbal > 0 AND name LIKE '%7'").select("id", "acctbal", "name")


def records_newest(spark, sf):
    """Of the records in a box the first by balance, cut off at a limit, and whether the limit was hit."""
    found = records(spark, _published(spark, sf), FIELDS, box=(40.6, -74.1, 40.8, -73.9), order="acctbal", descending=True, limit=NEWEST)
    return found.agg(F.count("*").alias("n_records"), (F.count("*") >= NEWEST).alias("n_truncated"), F.round(F.min("acctbal"), 2).alias("least"), F.sum("id").alias("ids"))


_ALL = points_sql("customer", "c_custkey", 0, "CAST(c_acctbal AS DOUBLE) AS acctbal, c_name AS name")
_FAR = f"2 * CAST(6371000 AS DOUBLE) * asin(sqrt(pow(sin(radians(lat - {CENTRE[0]}) / 2), 2) + cos(radians(CAST({CENTRE[0]} AS DOUBLE))) * cos(radians(lat)) * pow(sin(radians(lon - CAST({CENTRE[1]} AS DOUBLE)) / 2), 2)))"
CIRCLE = f"SELECT id, acctbal, name FROM {_ALL} WHERE {_FAR} <= {RADIUS} AND acctbal > 0 AND name LIKE '%7'"
NEWEST_SQL = f"""
SELECT count(*) AS n_records, count(*) >= {NEWEST} AS n_truncated, round(min(acctbal), 2) AS least, CAST(sum(id) AS BIGINT) AS ids FROM (
  SELECT * FROM {_ALL} WHERE lat BETWEEN 40.6 AND 40.8 AND lon BETWEEN -74.1 AND -73.9 ORDER BY acctbal DESC, id LIMIT {NEWEST})"""

#: Tiles of one place: a tenth of the keys, of those with few clouds.
_TILES = "p_partkey % 2000 BETWEEN 400 AND 599 AND p_size * 2 BETWEEN 10 AND 40"


def row_group_read(spark, sf):
    """Rows of chosen tiles, from the row groups that hold them: their number and quantity, and whether less than a third of all rows was read."""
    path = shared.new_path(spark, "tiles")
    rowgroups.write_clustered(load(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_tax"), "l_partkey", path, 1000, 8)
    groups = rowgroups.index(spark, path, "l_partkey")
    wanted = load(spark, sf, "part").where(_TILES).select(F.col("p_partkey").alias("l_partkey"))
    rows = rowgroups.read(groups, wanted, "l_partkey", "l_partkey long, l_quantity double")
    share = rowgroups.chosen(groups, wanted, "l_partkey", 1000).agg(F.sum("n")).first()[0] / groups.agg(F.sum("n")).first()[0]
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("pruned", F.lit(share < 1 / 3))


ROW_GROUPS = f"SELECT l_partkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, true AS pruned FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE {_TILES}) GROUP BY l_partkey"

QUERIES = {"row_group_read": (row_group_read, ROW_GROUPS), "records_in_circle": (records_in_circle, CIRCLE), "records_newest": (records_newest, NEWEST_SQL)}
