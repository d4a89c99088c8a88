"""Queries through files: tables written by the sinks and read back by the readers, and fetches by a given function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster, spatial, timeseries
from ..sources import readers, shared, sinks
from .register import _SCORED, ranked_register
from .series import RESIDUAL, residual_aligned
from .spatial import ASSETS, HAZARDS, _assets, _hazards
from .tables import BOXES_SQL, boxes, load, points, points_sql

_ASSETS_NAMED = points_sql("customer", "c_custkey", 0, "c_name AS name, c_custkey % 11 <> 0 AS known")


def _named(spark, sf):
    return points(load(spark, sf, "customer"), "c_custkey", 0, "c_name AS name", "c_custkey % 11 <> 0 AS known")


def geojson_points(spark, sf):
    """Features written a line each and read back: points only, one property of each; others are left out silently."""
    p = _named(spark, sf)
    path = shared.new_path(spark, "features")
    polygon = F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{}}')
    one = F.when(F.col("known"), sinks.feature(F.col("lat"), F.col("lon"), ["id", "name"])).otherwise(polygon)
    p.select(one.alias("value")).write.text(path)
    read = readers.points_only(readers.geojson_lines(spark, path, ["id", "none"]))
    return read.select(F.col("id").cast("long").alias("id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "none")


GEOJSON = f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(NULL AS VARCHAR) AS none FROM {_ASSETS_NAMED} WHERE known"


def csv_points(spark, sf):
    """Points written as text with a separator of their own and read back: rows whose coordinates are no numbers are left out."""
    p = _named(spark, sf)
    path = shared.new_path(spark, "csv")
    text = lambda c: F.when(F.col("id") % 13 == 0, "").when(F.col("id") % 17 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col(c).cast("string")))
    p.select("id", text("lat").alias("latitude"), text("lon").alias("longitude"), "name").write.option("header", True).option("sep", ";").csv(path)
    return readers.csv_points(spark, path, sep=";").select(F.col("id").cast("long").alias("id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "name")


CSV = f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, name FROM {_ASSETS_NAMED} WHERE id % 13 <> 0 AND id % 17 <> 0"


def marks_ingest(spark, sf):
    """Marks with coordinates written as features with nine properties, and read back."""
    keep = ["id", "elev_ft", "height", "kind", "quality", "county", "site", "waterbody", "state"]
    marks = _hazards(spark, sf).select(F.when(F.col("id") % 5 != 0, F.col("lat")).alias("lat"), "lon", "id", (F.col("id") % 64 / 8).alias("elev_ft"), (F.col("id") % 16 / 4).alias("height"), *[F.concat(F.lit(f"{c} "), (F.col("id") % 7).cast("string")).alias(c) for c in keep[3:]])
    path = shared.new_path(spark, "marks")
    sinks.feature_lines(marks.where("lat IS NOT NULL AND lon IS NOT NULL"), path, keep)
    return readers.geojson_lines(spark, path, keep).select(F.col("id").cast("long").alias("id"), F.col("elev_ft").cast("double").alias("elev_ft"), "county", "state", F.round("lat", 6).alias("lat"))


MARKS_INGEST = f"SELECT id, CAST(id % 64 AS DOUBLE) / 8 AS elev_ft, 'county ' || id % 7 AS county, 'state ' || id % 7 AS state, round(lat, 6) AS lat FROM {HAZARDS} WHERE id % 5 <> 0"


def polygon_scan(spark, sf):
    """Polygons kept as Parquet and read back: their areas, by the sum over their sides."""
    path = shared.new_path(spark, "polygons")
    boxes(load(spark, sf, "part")).select("id", "class", "half", "rings").write.parquet(path)
    ring = F.get("rings", F.lit(0))
    cross = F.zip_with(ring, F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a.x * b.y - b.x * a.y)
    area = F.abs(F.aggregate(F.filter(cross, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)) / 2
    return spark.read.parquet(path).select("id", "class", F.round(area, 9).alias("area"))


POLYGONS = f"SELECT id, class, round(2 * half * half, 9) AS area FROM {BOXES_SQL}"


def register_csv(spark, sf):
    """The ranked register written as text and read back: assets, best and mean score of each tier."""
    path = shared.new_path(spark, "register")
    sinks.ranked_csv(ranked_register(spark, sf).withColumnRenamed("c_name", "name"), path)
    read = spark.read.option("header", True).schema("id long, name string, score double, tier long").csv(path)
    return read.groupBy("tier").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.round(F.avg("score"), 4).alias("mean"))


REGISTER_CSV = f"{_SCORED} SELECT tier, count(*) AS n, max(score) AS best, round(avg(score), 4) AS mean FROM f WHERE tier > 0 GROUP BY tier"


def register_json(spark, sf):
    """The register written as JSON lines and read back: its rows near a point."""
    path = shared.new_path(spark, "register")
    sinks.json_lines(_assets(spark, sf), path)
    read = spark.read.schema("id long, lat double, lon double").json(path)
    return read.where(geo.within(F.col("lat"), F.col("lon"), -74.05, 40.65, -73.95, 40.75)).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


REGISTER_JSON = f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {ASSETS} WHERE lon BETWEEN -74.05 AND -73.95 AND lat BETWEEN 40.65 AND 40.75"


def append_resume(spark, sf):
    """A register built twice, the second time in full: rows whose places are done are not built again."""
    path = shared.new_path(spark, "resumed")
    rows = _hazards(spark, sf).select("id", "lat", "lon")
    sinks.append_new(rows.where("id % 3 = 0"), path)
    sinks.append_new(rows, path)
    sinks.append_new(rows, path)
    return spark.read.parquet(path).select("id", F.round("lat", 6).alias("lat"))


RESUME = f"""
WITH h AS (SELECT id, round(lat, 5) AS a, round(lon, 5) AS o, lat FROM {HAZARDS})
SELECT id, round(lat, 6) AS lat FROM h WHERE id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM h d WHERE d.id % 3 = 0 AND d.a = h.a AND d.o = h.o)"""


def layer_collections(spark, sf):
    """A feature collection for each tile of 0.1 degrees: how many features, and that they read back as JSON."""
    at = lambda c: F.floor(F.col(c) * 10).cast("long")
    made = sinks.feature_collections(_assets(spark, sf).withColumn("ty", at("lat")).withColumn("tx", at("lon")), ["ty", "tx"], ["id"])
    read = F.from_json("collection", "type string, features array<struct<properties:struct<id:long>>>")
    ids = F.transform(read["features"], lambda f: f.properties.id)
    return made.select("ty", "tx", "n", read["type"].alias("type"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"))


LAYERS = f"SELECT CAST(floor(lat * 10) AS BIGINT) AS ty, CAST(floor(lon * 10) AS BIGINT) AS tx, count(*) AS n, 'FeatureCollection' AS type, min(id) AS first, max(id) AS last FROM {ASSETS} GROUP BY 1, 2"


def simplified_rings(spark, sf):
    """Rings of 40 points on straight sides, clipped to a box of places and thinned: only their corners stay."""
    b = boxes(load(spark, sf, "part")).where("c_lat BETWEEN 40.6 AND 40.8").select("id", "half", F.col("box_ring").alias("ring"))
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct((F.get("ring", i).x + (F.get("ring", i + 1).x - F.get("ring", i).x) * k / 10).alias("x"), (F.get("ring", i).y + (F.get("ring", i + 1).y - F.get("ring", i).y) * k / 10).alias("y"))))
    fine = F.concat(F.flatten(sides), F.array(F.get("ring", F.lit(0))))
    thin = raster.simplified(b.select("id", F.size(fine).cast("long").alias("before"), fine.alias("ring")), "ring", 1e-7)
    return thin.select("id", "before", F.size("ring").cast("long").alias("after"), F.round(F.array_max(F.transform("ring", lambda p: p.x)) - F.array_min(F.transform("ring", lambda p: p.x)), 6).alias("width"))


SIMPLIFIED = f"SELECT id, 41 AS before, 5 AS after, round(2 * half, 6) AS width FROM {BOXES_SQL} WHERE lat BETWEEN 40.6 AND 40.8"


def audit_lines(spark, sf):
    """An audit of runs written as JSON lines and read back: runs, failures and the longest, by outcome."""
    path = shared.new_path(spark, "audit")
    runs = load(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.length("text")).alias("longest"))
    sinks.json_lines(runs.select("conv_id", "turns", F.struct((F.col("longest") < 200).alias("ok"), "longest").alias("result")), path)
    read = spark.read.schema("conv_id long, turns long, result struct<ok:boolean,longest:long>").json(path)
    return read.groupBy("result.ok").agg(F.count("*").alias("runs"), F.sum("turns").alias("turns"), F.max("result.longest").alias("longest"))


AUDIT_LINES = """
SELECT longest < 200 AS ok, count(*) AS runs, CAST(sum(turns) AS BIGINT) AS turns, max(longest) AS longest FROM (SELECT conv_id, count(*) AS turns, max(length(text)) AS longest FROM conversations GROUP BY conv_id) GROUP BY 1"""


def scene_pairs(spark, sf):
    """A manifest of scenes before and after each purchase of a user (the nearest views within a day), as JSON lines, read back."""
    e = load(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("id"), "event_type")
    after, before = e.where("event_type = 'purchase'"), e.where("event_type = 'error'")
    path = shared.new_path(spark, "pairs")
    sinks.json_lines(timeseries.nearest_in_time(after, before, "user_id", 24 * 3600).select(F.col("left_id").alias("post"), F.col("right_id").alias("pre"), F.round(F.col("delta_s") / 3600, 4).alias("hours")), path)
    return spark.read.schema("post long, pre long, hours double").json(path)


PAIRED = """
SELECT a.event_id AS post, b.event_id AS pre, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 / 3600, 4) AS hours FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error'
WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 <= 86400 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.event_id) = 1"""


def residual_table(spark, sf):
    """Residuals kept as Parquet and read back, two columns of them."""
    path = shared.new_path(spark, "residuals")
    residual_aligned(spark, sf).write.parquet(path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("residual"), 6).alias("total"))


RESIDUALS = f"SELECT user_id, count(*) AS n, round(sum(residual), 6) AS total FROM ({RESIDUAL}) GROUP BY user_id"


def _answer(row: dict) -> dict | None:
    """A service for the test of fetches: fails on some requests and has nothing for others."""
    if row["query_id"] % 7 == 0:
        raise TimeoutError("no answer")
    return None if row["query_id"] % 5 == 0 else {"data": {"score": row["query_id"] * 2}, "items": [{"name": f"n{row['query_id']}"}]}


def fetched_records(spark, sf):
    """What a service answers to each supplier: values at paths of its JSON; failures and empty answers are rows of their own."""
    asked = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"))
    got = readers.fetched(asked, _answer)
    return got.select("query_id", "status", readers.json_path(F.col("value"), "data.score").cast("long").alias("score"), readers.json_path(F.col("value"), "items[0].name").alias("name"), "error")


FETCHED = """
SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 7 = 0 THEN 'error' WHEN s_suppkey % 5 = 0 THEN 'offline' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN s_suppkey * 2 END AS score,
  CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN 'n' || s_suppkey END AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'TimeoutError: no answer' END AS error FROM supplier"""


def nearest_far(spark, sf):
    """The nearest asset of places all over the country, most of them far from any, at whatever distance."""
    far = load(spark, sf, "customer").selectExpr("c_custkey AS id", "CAST(24 AS DOUBLE) + CAST(c_custkey * 7919 % 2600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat", "CAST(-126 AS DOUBLE) + CAST(c_custkey * 104729 % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon")
    near = spatial.nearest_any(far, _hazards(spark, sf).select("id", "lat", "lon"), 1000.0)
    return near.select("query_id", "feature_id", F.round(F.col("distance_m") / 1000, 3).alias("km"))


def _far_sql() -> str:
    from .tables import haversine_sql

    far = "(SELECT c_custkey AS id, CAST(24 AS DOUBLE) + CAST(c_custkey * 7919 % 2600 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, CAST(-126 AS DOUBLE) + CAST(c_custkey * 104729 % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM customer)"
    return f"SELECT q.id AS query_id, h.id AS feature_id, round({haversine_sql('q', 'h')} / 1000, 3) AS km FROM {far} q, {HAZARDS} h QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {haversine_sql('q', 'h')}, h.id) = 1"


QUERIES = {
    "geojson_points": (geojson_points, GEOJSON), "csv_points": (csv_points, CSV), "marks_ingest": (marks_ingest, MARKS_INGEST), "polygon_scan": (polygon_scan, POLYGONS), "register_csv": (register_csv, REGISTER_CSV),
    "register_json": (register_json, REGISTER_JSON), "append_resume": (append_resume, RESUME), "layer_collections": (layer_collections, LAYERS), "simplified_rings": (simplified_rings, SIMPLIFIED), "audit_lines": (audit_lines, AUDIT_LINES),
    "scene_pairs": (scene_pairs, PAIRED), "residual_table": (residual_table, RESIDUALS), "fetched_records": (fetched_records, FETCHED), "nearest_far": (nearest_far, _far_sql()),
}
