"""The exposure register: assets against hazard points, polygons and rasters, scored, tiered and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import spatial
from .spatial import _IN, ASSETS, _assets, _held
from .tables import BOXES_SQL, haversine_sql, load, points, points_sql

RADIUS = 2000.0


def exposure(spark, sf) -> DataFrame:
    """Each asset with its indicators: flags and depth classes of polygons, hazard points near by, terrain and records."""
    assets = _assets(spark, sf)
    held = _held(spark, sf, assets).withColumnRenamed("class", "depth")
    marks = points(load(spark, sf, "supplier"), "s_suppkey", 50000)
    near = spatial.radius_fold(assets, marks, RADIUS, [F.count("*").alias("here")], [F.sum("here").alias("marks"), F.min("distance_m").alias("mark_m")])
    records = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("complaints"))
    ground = assets.withColumn("hand", (F.col("id") * 31) % 97 / 4).withColumn("twi", ((F.col("id") * 17) % 15).cast("double"))
    joined = spatial.back(spatial.back(ground, held), near).join(records, "id", "left")
    return joined.select(
        "id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("zones", F.lit(0).cast("long")).alias("zones"), F.coalesce("marks", F.lit(0).cast("long")).alias("marks"), "mark_m",
        F.coalesce("complaints", F.lit(0).cast("long")).alias("complaints"), "hand", "twi",
    )


def scored(spark, sf) -> DataFrame:
    """Sub-indices, composite (0 to 3), score (0 to 100) and tier; a flood mark within 500 m lifts the tier to 2 at least."""
    x = exposure(spark, sf)
    regulatory = scoring.sub_index([(F.col("depth") >= 1, 1.0), (F.col("depth") >= 2, 0.75), (F.col("depth") >= 3, 0.5)])
    terrain = scoring.sub_index([(scoring.band("hand", F.col("hand")), 1.0), (scoring.band("twi", F.col("twi")), 0.5)])
    record = scoring.sub_index([(F.col("marks") > 0, 1.0), (scoring.band("complaints", F.col("complaints")), 0.75)])
    out = x.withColumn("regulatory", regulatory).withColumn("terrain", terrain).withColumn("record", record).withColumn("composite", F.col("regulatory") + F.col("terrain") + F.col("record"))
    floored = F.coalesce(F.col("mark_m") <= 500.0, F.lit(False))
    return out.withColumn("floored", floored).withColumn("tier", scoring.tier(F.col("composite"), floored)).withColumn("score", F.round(100 * F.col("composite") / 3, 3))


def exposure_score(spark, sf):
    """All indicators and scores of each asset."""
    return scored(spark, sf).select("id", "depth", "zones", "marks", "complaints", *[F.round(c, 4).alias(c) for c in ("regulatory", "terrain", "record", "composite")], F.col("tier").cast("long").alias("tier"), "floored")


_TERRAIN = """CASE WHEN h < 1 THEN 1.0 WHEN h < 3 THEN 0.66 WHEN h < 10 THEN 0.33 ELSE 0.0 END AS hb, CASE WHEN t >= 12 THEN 1.0 WHEN t >= 10 THEN 0.66 WHEN t >= 8 THEN 0.33 ELSE 0.0 END AS tb,
  CASE WHEN complaints >= 10 THEN 1.0 WHEN complaints >= 3 THEN 0.66 WHEN complaints >= 1 THEN 0.33 ELSE 0.0 END AS cb"""
_SCORED = f"""
WITH a AS (SELECT * FROM {ASSETS}), z AS (SELECT a.id, max(class) AS depth, count(*) AS zones FROM a JOIN {BOXES_SQL} p ON {_IN} GROUP BY a.id),
m AS (SELECT a.id, count(*) AS marks, min({haversine_sql("a", "s")}) AS mark_m FROM a JOIN {points_sql("supplier", "s_suppkey", 50000)} s ON {haversine_sql("a", "s")} <= {RADIUS} GROUP BY a.id),
r AS (SELECT o_custkey AS id, count(*) AS complaints FROM orders GROUP BY ALL),
x AS (SELECT a.id, coalesce(depth, 0) AS depth, coalesce(zones, 0) AS zones, coalesce(marks, 0) AS marks, mark_m, coalesce(complaints, 0) AS complaints, CAST((a.id * 31) % 97 AS DOUBLE) / 4 AS h, CAST((a.id * 17) % 15 AS DOUBLE) AS t
  FROM a LEFT JOIN z USING (id) LEFT JOIN m USING (id) LEFT JOIN r USING (id)),
y AS (SELECT *, {_TERRAIN} FROM x),
s AS (SELECT *, CAST(CASE WHEN depth >= 3 THEN 2.25 WHEN depth >= 2 THEN 1.75 WHEN depth >= 1 THEN 1 ELSE 0 END AS DOUBLE) / CAST(2.25 AS DOUBLE) AS regulatory, (CAST(hb AS DOUBLE) + CAST(tb AS DOUBLE) * CAST(0.5 AS DOUBLE)) / CAST(1.5 AS DOUBLE) AS terrain,
  (CASE WHEN marks > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(cb AS DOUBLE) * CAST(0.75 AS DOUBLE)) / CAST(1.75 AS DOUBLE) AS record, coalesce(mark_m <= 500, false) AS floored FROM y),
c AS (SELECT *, regulatory + terrain + record AS composite FROM s),
t AS (SELECT *, CASE WHEN composite >= 1.5 THEN 1 WHEN composite >= 1.0 THEN 2 WHEN composite >= 0.5 THEN 3 WHEN composite >= 0.01 THEN 4 ELSE 0 END AS t0 FROM c),
f AS (SELECT *, CAST(CASE WHEN floored AND (t0 = 0 OR t0 > 2) THEN 2 ELSE t0 END AS BIGINT) AS tier, round(100 * composite / 3, 3) AS score FROM t)"""
EXPOSURE = f"{_SCORED} SELECT id, depth, zones, marks, complaints, round(regulatory, 4) AS regulatory, round(terrain, 4) AS terrain, round(record, 4) AS record, round(composite, 4) AS composite, tier, floored FROM f"


def ranked_register(spark, sf):
    """The register: assets with any exposure by score, the highest first; names, then ids break ties."""
    names = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return scored(spark, sf).where("tier > 0").join(names, "id").select("id", "c_name", "score", F.col("tier").cast("long").alias("tier")).orderBy(F.desc("score"), "c_name", "id")


RANKED = f"{_SCORED} SELECT id, c_name, score, tier FROM f JOIN customer ON c_custkey = id WHERE tier > 0"


def tier_distribution(spark, sf):
    """Assets of each tier, with the totals of their signals."""
    return scored(spark, sf).groupBy(F.col("tier").cast("long").alias("tier")).agg(F.count("*").alias("n"), F.sum("zones").alias("zones"), F.sum("marks").alias("marks"), F.count_if("floored").alias("floored"))


TIERS = f"{_SCORED} SELECT tier, count(*) AS n, CAST(sum(zones) AS BIGINT) AS zones, CAST(sum(marks) AS BIGINT) AS marks, count(*) FILTER (floored) AS floored FROM f GROUP BY tier"

QUERIES = {"ranked_register": (ranked_register, RANKED), "exposure_score": (exposure_score, EXPOSURE), "tier_distribution": (tier_distribution, TIERS)}
