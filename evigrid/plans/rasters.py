"""Queries on rasters, whose cells are the rows of orders or customers by key, a fixed number of them in each row of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, terrain
from .tables import load


def built_coverage(spark, sf):
    """Of each tile of 25 x 25 cells: the built share, and the 4-connected areas of built cells."""
    cells = load(spark, sf, "orders").selectExpr("o_orderkey DIV 100 AS row", "o_orderkey % 100 AS col", "CAST((o_custkey * 31 + o_orderkey) % 100 AS DOUBLE) AS value")
    out = raster.areas(raster.tiled(cells, 25), 25, 60.0)
    return out.select("tile_row", "tile_col", F.round("share", 6).alias("share"), "areas", "largest")


BUILT = """
WITH RECURSIVE c AS (SELECT o_orderkey AS id, o_orderkey // 100 AS r, o_orderkey % 100 AS c FROM orders WHERE (o_custkey * 31 + o_orderkey) % 100 >= 60),
reach(id, other, r, c) AS (SELECT id, id, r, c FROM c UNION SELECT reach.id, n.id, n.r, n.c FROM reach JOIN c n ON abs(n.r - reach.r) + abs(n.c - reach.c) = 1 AND n.r // 25 = reach.r // 25 AND n.c // 25 = reach.c // 25),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id), sizes AS (SELECT root, count(*) AS n FROM roots GROUP BY root)
SELECT root // 100 // 25 AS tile_row, root % 100 // 25 AS tile_col, round(sum(n) / 625.0, 6) AS share, count(*) AS areas, max(n) AS largest FROM sizes GROUP BY ALL"""


def filled_gaps(spark, sf):
    """A raster with a third of its cells missing, filled from the nearest squares around them: sums by row."""
    cells = load(spark, sf, "customer").selectExpr("c_custkey DIV 60 AS row", "c_custkey % 60 AS col", "CASE WHEN (c_custkey * 7919) % 100 >= 35 THEN c_acctbal END AS value")
    return raster.filled(cells).groupBy("row").agg(F.round(F.sum("value"), 6).alias("total"), F.count("value").alias("n"))


FILLED = """
WITH g AS (SELECT c_custkey // 60 AS r, c_custkey % 60 AS c, CASE WHEN (c_custkey * 7919) % 100 >= 35 THEN c_acctbal END AS v FROM customer),
m AS (SELECT g.r, g.c, """ + ", ".join(f"avg(n.v) FILTER (greatest(abs(n.r - g.r), abs(n.c - g.c)) <= {k}) AS m{k}" for k in range(1, 6)) + """
  FROM g JOIN g n ON g.v IS NULL AND n.v IS NOT NULL AND abs(n.r - g.r) <= 5 AND abs(n.c - g.c) <= 5 GROUP BY ALL)
SELECT g.r AS row, round(sum(coalesce(v, m1, m2, m3, m4, m5)), 6) AS total, count(coalesce(v, m1, m2, m3, m4, m5)) AS n FROM g LEFT JOIN m ON m.r = g.r AND m.c = g.c GROUP BY g.r"""  # fmt: skip



def class_polygons(spark, sf):
    """Rasters of classes of two scenes as polygons, put together: areas of each tile and class, their size and the length of their sides."""
    scene = lambda k: load(spark, sf, "customer").selectExpr("c_custkey DIV 60 AS row", "c_custkey % 60 AS col", f"CAST((c_custkey DIV 3 * {k} + c_nationkey DIV 9) % 4 AS DOUBLE) AS value")
    both = [raster.outlines(raster.tiled(scene(k), 20), 20).withColumn("scene", F.lit(k).cast("long")) for k in (17, 23)]
    side = lambda ring: F.zip_with(ring, F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct((a.x * b.y - b.x * a.y).alias("cross"), (F.abs(a.x - b.x) + F.abs(a.y - b.y)).alias("length")))
    sides = F.flatten(F.transform("rings", side))
    total = lambda f: F.aggregate(sides, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e[f], F.lit(0).cast("long")))
    p = both[0].unionByName(both[1]).withColumn("area", total("cross") / 2).withColumn("length", total("length"))
    return p.groupBy("scene", "tile_row", "tile_col", "class").agg(F.sum("cells").alias("cells"), F.sum("area").cast("long").alias("area"), F.sum("length").alias("sides"), F.max("cells").alias("largest"))


#: The cells of a class, their sides towards others or the edge of the tile, and the largest of their areas.
CLASS_POLYGONS = """
WITH RECURSIVE s AS (SELECT unnest([17, 23]) AS scene), c AS (SELECT scene, c_custkey AS id, c_custkey // 60 AS r, c_custkey % 60 AS c, (c_custkey // 3 * scene + c_nationkey // 9) % 4 AS v FROM s, customer),
n AS (SELECT a.scene, a.id, count(*) AS met FROM c a JOIN c b ON a.scene = b.scene AND a.v = b.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.r // 20 = b.r // 20 AND a.c // 20 = b.c // 20 GROUP BY ALL),
reach(scene, id, other, r, c, v) AS (SELECT scene, id, id, r, c, v FROM c WHERE v > 0 UNION SELECT x.scene, x.id, y.id, y.r, y.c, y.v FROM reach x JOIN c y ON x.scene = y.scene AND x.v = y.v AND abs(x.r - y.r) + abs(x.c - y.c) = 1 AND x.r // 20 = y.r // 20 AND x.c // 20 = y.c // 20),
z AS (SELECT scene, id, count(*) AS size FROM reach GROUP BY ALL)
SELECT CAST(scene AS BIGINT) AS scene, r // 20 AS tile_row, c // 20 AS tile_col, v AS class, count(*) AS cells, count(*) AS area, CAST(sum(4 - coalesce(met, 0)) AS BIGINT) AS sides, max(size) AS largest FROM c LEFT JOIN n USING (scene, id) JOIN z USING (scene, id) WHERE v > 0 GROUP BY ALL"""

def terrain_indices(spark, sf):
    """A raster of heights with ridges and pits: cells drained, streams, heights above them and wetness of each cell."""
    cells = load(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS bump").selectExpr("id DIV 60 AS row", "id % 60 AS col", f"{_HEIGHT.replace('//', 'DIV')} AS value")
    out = terrain.indices(cells, 30.0, 25)
    return out.select("row", "col", "n", "stream", F.round("hand", 6).alias("hand"), F.round("twi", 6).alias("twi"))


_HEIGHT = "CASE WHEN id % 97 <> 5 THEN CAST(400 - 3 * (id // 60) - 2 * (id % 60) + bump % 11 + abs(id % 60 - 30) * 4 AS DOUBLE) END"
TERRAIN_INDICES = f"""
WITH RECURSIVE z AS (SELECT id, id // 60 AS r, id % 60 AS c, v FROM (SELECT id, {_HEIGHT} AS v FROM (SELECT c_custkey AS id, c_nationkey AS bump FROM customer)) WHERE v IS NOT NULL),
f AS (SELECT a.id, b.id AS dest, (a.v - b.v) / sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS fall FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.v > b.v QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY fall DESC, b.r, b.c) = 1),
path(id, pos, step) AS (SELECT id, id, 0 FROM z UNION ALL SELECT path.id, f.dest, step + 1 FROM path JOIN f ON f.id = path.pos),
n AS (SELECT pos AS id, count(*) AS n FROM path GROUP BY pos),
bed AS (SELECT path.id, z.v AS bed FROM path JOIN n ON n.id = path.pos AND n >= 25 JOIN z ON z.id = path.pos QUALIFY row_number() OVER (PARTITION BY path.id ORDER BY step) = 1)
SELECT r AS row, c AS col, n, n >= 25 AS stream, round(v - bed, 6) AS hand, round(ln(n * CAST(30 AS DOUBLE) / greatest(coalesce(fall, 0) / 30, CAST(0.001 AS DOUBLE))), 6) AS twi FROM z JOIN n USING (id) LEFT JOIN f USING (id) LEFT JOIN bed USING (id)"""

QUERIES = {"terrain_indices": (terrain_indices, TERRAIN_INDICES), "class_polygons": (class_polygons, CLASS_POLYGONS), "built_coverage": (built_coverage, BUILT), "filled_gaps": (filled_gaps, FILLED)}
