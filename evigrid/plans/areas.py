"""Queries on polygons with holes: overlap, its rollup, burning and union shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import borders, polygons
from .spatial import ASSETS, HAZARDS, _assets, _hazards
from .tables import BOXES_SQL, boxes, load

#: Half the side of a development, a box about a supplier; cells of pairs; a grid whose centres lie off the points' lattice.
OWN = 0.00505
CELL, GRID_X, GRID_Y, GRID = 0.05, -74.4001371, 40.4001793, 0.001
# Feet a degree of latitude and (at this latitude) longitude of a plane; square feet a square metre.
FEET_Y, FEET_X, SQUARE_FEET = 364_567.2, 276_800.0, 10.7639


def _developments(spark, sf):
    corner = lambda sx, sy: F.struct((F.col("lon") + sx * OWN).alias("x"), (F.col("lat") + sy * OWN).alias("y"))
    return _hazards(spark, sf).select("id", F.array(F.array(*[corner(*c) for c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])).alias("rings"))


def _zones(spark, sf):
    """Diamonds with a diamond of half their size cut out."""
    b = boxes(load(spark, sf, "part"))
    corner = lambda sx, sy: F.struct((F.col("c_lon") + sx * F.col("half") / 2).alias("x"), (F.col("c_lat") + sy * F.col("half") / 2).alias("y"))
    hole = F.array(*[corner(*c) for c in ((0, -1), (-1, 0), (0, 1), (1, 0), (0, -1))])
    return b.select("id", "class", F.concat("rings", F.array(hole)).alias("rings"))


def _by_class(spark, sf):
    found = polygons.overlap_classes(_developments(spark, sf), _zones(spark, sf), CELL)
    # Overlaps are summed, so that a share can exceed 1.
    return found.select("id", "class", (F.col("shared") / F.col("area")).alias("share"), "shared", F.col("n").alias("zones"))


def polygon_overlap(spark, sf):
    """Per development and class of zone: the share of its area in zones (overlaps summed), the number of zones, and whether it is half or more."""
    return _by_class(spark, sf).select("id", "class", F.round("share", 6).alias("share"), "zones", (F.col("share") >= 0.5).alias("majority"))


def overlap_rollup(spark, sf):
    """Per class of zone: developments with any overlap, with half or more, and the square kilometres they share."""
    km2 = F.col("shared") * (FEET_X * FEET_Y / SQUARE_FEET / 1e6)
    return _by_class(spark, sf).groupBy("class").agg(F.count("*").alias("n_any"), F.count_if(F.col("share") >= 0.5).alias("n_majority"), F.round(F.sum(km2), 5).alias("km2"))


def _corner_sql(x: str, y: str, h: str) -> str:
    """Area of the diamond |u| + |v| <= h with u <= x and v <= y, by integration over u."""
    cx, cy = (f"greatest(-{h}, least({h}, {c}))" for c in (x, y))
    up = lambda u: (
        f"(CASE WHEN {cy} >= 0 THEN ({cy} + {h}) * least({u}, {h} - {cy}) - pow(least({u}, {h} - {cy}), 2) / 2"
        f" + CASE WHEN {u} > {h} - {cy} THEN 2 * {h} * {u} - pow({u}, 2) - 2 * {h} * ({h} - {cy}) + pow({h} - {cy}, 2) ELSE 0 END"
        f" ELSE ({cy} + {h}) * least({u}, {h} + {cy}) - pow(least({u}, {h} + {cy}), 2) / 2 END)"
    )
    return f"({up(h)} + sign({cx}) * {up(f'abs({cx})')})"


def _shared_sql(h: str) -> str:
    """Area that a development d and a diamond of half-width h about a zone p share."""
    side = [f"(d.lon - p.lon + {s} * CAST({OWN} AS DOUBLE))" for s in (-1, 1)], [f"(d.lat - p.lat + {s} * CAST({OWN} AS DOUBLE))" for s in (-1, 1)]
    at = lambda i, j: _corner_sql(side[0][i], side[1][j], h)
    return f"({at(1, 1)} - {at(0, 1)} - {at(1, 0)} + {at(0, 0)})"


_PAIRS = f"""
WITH s AS (
  SELECT d.id, p.class, {_shared_sql("p.half")} - {_shared_sql("(p.half / 2)")} AS shared FROM {HAZARDS} d, {BOXES_SQL} p
  WHERE abs(d.lon - p.lon) <= p.half + CAST({OWN} AS DOUBLE) AND abs(d.lat - p.lat) <= p.half + CAST({OWN} AS DOUBLE)),
c AS (SELECT id, class, sum(shared) AS shared, sum(shared) / pow(2 * CAST({OWN} AS DOUBLE), 2) AS share, count(*) AS zones FROM s WHERE shared > 1e-14 GROUP BY id, class)"""
OVERLAP = f"{_PAIRS} SELECT id, class, round(share, 6) AS share, zones, share >= 0.5 AS majority FROM c"
ROLLUP = f"""{_PAIRS}
SELECT class, count(*) AS n_any, count(*) FILTER (share >= 0.5) AS n_majority, round(sum(shared * CAST({FEET_X * FEET_Y / SQUARE_FEET / 1e6!r} AS DOUBLE)), 5) AS km2 FROM c GROUP BY class"""


def burnt_zones(spark, sf):
    """Zones with holes burnt into a grid by cell centres, the highest class winning: cells of each class."""
    return polygons.burnt_classes(_zones(spark, sf), GRID_X, GRID_Y, GRID).groupBy("class").agg(F.count("*").alias("cells"))


def union_share(spark, sf):
    """Per development: the percentage of its cells in any zone, and in zones of class 3, zones that overlap counted once."""
    found = polygons.union_shares(_developments(spark, sf), _zones(spark, sf), GRID_X, GRID_Y, GRID, 3)
    pct = lambda c: F.round(100 * F.col(c) / F.greatest(F.col("cells"), F.lit(1)), 2)
    return found.select("id", "cells", pct("covered").alias("pct_any"), pct("deep_covered").alias("pct_deep"))


def _cells_sql(of: str, half: str, inside: str, more: str) -> str:
    """All centres of the grid in the box of half-width `half` about each row of `of` (lon, lat) that fulfil a condition."""
    span = lambda c, g, n: f"unnest(generate_series(CAST(floor(({c} - {half} - CAST({g} AS DOUBLE)) / CAST({GRID} AS DOUBLE)) AS BIGINT), CAST(ceil(({c} + {half} - CAST({g} AS DOUBLE)) / CAST({GRID} AS DOUBLE)) AS BIGINT))) AS {n}"
    x, y = f"(CAST({GRID_X} AS DOUBLE) + (col + CAST(0.5 AS DOUBLE)) * CAST({GRID} AS DOUBLE))", f"(CAST({GRID_Y} AS DOUBLE) + (row + CAST(0.5 AS DOUBLE)) * CAST({GRID} AS DOUBLE))"
    return f"(SELECT row, col, {more} FROM (SELECT *, {span('lon', GRID_X, 'col')} FROM (SELECT *, {span('lat', GRID_Y, 'row')} FROM {of})) WHERE {inside.format(x=f'abs({x} - lon)', y=f'abs({y} - lat)')})"


_BURNT = f"(SELECT row, col, max(class) AS class FROM {_cells_sql(BOXES_SQL, 'half', '{x} + {y} <= half AND {x} + {y} > half / 2', 'class')} GROUP BY row, col)"
BURNT = f"SELECT class, count(*) AS cells FROM {_BURNT} GROUP BY class"
_OWN_CELLS = _cells_sql(HAZARDS, f"CAST({OWN} AS DOUBLE)", f"{{x}} <= CAST({OWN} AS DOUBLE) AND {{y}} <= CAST({OWN} AS DOUBLE)", "id")
UNION = f"""
SELECT id, count(*) AS cells, round(100 * count(class) / count(*), 2) AS pct_any, round(100 * count(*) FILTER (class >= 3) / count(*), 2) AS pct_deep
FROM {_OWN_CELLS} LEFT JOIN {_BURNT} USING (row, col) GROUP BY id"""

#: Districts are squares of 0.02 degrees that hold assets; the bends of their sides are wider than the tolerance, their ripples are not.
TOLERANCE = 0.0005
_BENT = "(({row} * 7 + {col} * 13 + {way}) % 3 = 0)"


def _district_rings(spark, sf):
    """id, row, col and ring of each district: its corners, and three points on each side that both neighbours have alike."""
    cells = _assets(spark, sf).select(F.floor(F.col("lat") * 50).alias("row"), F.floor(F.col("lon") * 50).alias("col")).distinct()

    def side(row: str, col: str, across: bool) -> str:
        """Points from the lower left end of a side on, its far end aside."""
        bent = _BENT.format(row=f"({row})", col=f"({col})", way=int(across))
        off = [f"(CASE WHEN {bent} THEN {b} ELSE {r} END)" for b, r in ((0.0, 0.0), (0.0021, 0.0001), (0.004, -0.0001), (0.0021, 0.0001))]
        along = [f"(({col if across else row}) * 4 + {k}) / 200.0D" for k in range(4)]
        still = f"({row if across else col}) / 50.0D"
        points = [(a, f"{still} + {o}") if across else (f"{still} + {o}", a) for a, o in zip(along, off)]
        return "array(" + ", ".join(f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)" for x, y in points) + ")"

    end = lambda row, col: f"array(struct(CAST(({col}) * 4 / 200.0D AS DOUBLE) AS x, CAST(({row}) / 50.0D AS DOUBLE) AS y))"
    up = lambda row, col: f"array(struct(CAST(({col}) / 50.0D + 0.0 AS DOUBLE) AS x, CAST(({row}) * 4 / 200.0D AS DOUBLE) AS y))"
    back = lambda far, points: f"concat({far}, reverse(slice({points}, 2, 3)))"
    ring = F.expr(f"concat({side('row', 'col', True)}, {side('row', 'col + 1', False)}, {back(end('row + 1', 'col + 1'), side('row + 1', 'col', True))}, {back(up('row + 1', 'col'), side('row', 'col', False))})")
    return cells.select((F.col("row") * 100_000 + F.col("col")).alias("id"), "row", "col", ring.alias("ring"))


def simplified_borders(spark, sf):
    """Districts thinned together: points before, corners and bends that stay, points that stay between them, and neighbours with a common border."""
    rings = _district_rings(spark, sf)
    thin = borders.simplified_together(rings.select("id", "ring"), TOLERANCE, 0.01)
    edges = thin.select("id", F.explode(F.expr("transform(sequence(1, size(ring) - 1), i -> struct(least(ring[i - 1], ring[i]) AS a, greatest(ring[i - 1], ring[i]) AS b))")).alias("e"))
    met = edges.join(edges.select(F.col("id").alias("other"), "e"), "e").where("id <> other").groupBy("id").agg(F.countDistinct("other").alias("neighbours"))
    joined = rings.withColumnRenamed("ring", "before").join(thin, "id").join(met, "id", "left")
    stays = lambda places: F.size(F.array_intersect(F.array(*[F.get("before", F.lit(i)) for i in places]), "ring")).cast("long")
    deep = [F.abs(F.get("before", F.lit(i))[c] * 50 - F.round(F.get("before", F.lit(i))[c] * 50)) > 0.1 for i, c in ((2, "y"), (6, "x"), (10, "y"), (14, "x"))]
    bends = sum((F.when(d & F.array_contains("ring", F.get("before", F.lit(i))), 1).otherwise(0) for d, i in zip(deep, (2, 6, 10, 14))), F.lit(0)).cast("long")
    return joined.select("id", F.size("before").cast("long").alias("n_before"), stays((0, 4, 8, 12)).alias("corners"), bends.alias("bends"), (F.size("ring") - 1 <= 10).alias("thinned"), F.coalesce("neighbours", F.lit(0).cast("long")).alias("neighbours"))


def _borders_sql() -> str:
    bent = lambda row, col, way: f"CAST({_BENT.format(row=row, col=col, way=way)} AS INT)"
    near = "(a.row = b.row AND abs(a.col - b.col) = 1 OR a.col = b.col AND abs(a.row - b.row) = 1)"
    sides = (("a.row", "a.col", 1), ("(a.row + 1)", "a.col", 1), ("a.row", "a.col", 0), ("a.row", "(a.col + 1)", 0))
    return f"""
WITH c AS (SELECT DISTINCT CAST(floor(lat * 50) AS BIGINT) AS row, CAST(floor(lon * 50) AS BIGINT) AS col FROM {ASSETS})
SELECT row * 100000 + col AS id, 16 AS n_before, 4 AS corners, {" + ".join(bent(*s) for s in sides)} AS bends, true AS thinned, (SELECT count(*) FROM c b WHERE {near}) AS neighbours FROM c a"""


def plane_centroids(spark, sf):
    """Zones taken to the plane, their centroids there, and these taken back: latitude and longitude."""
    b = boxes(load(spark, sf, "part"))
    corner = lambda p: (lambda e: F.struct(e[0].alias("x"), e[1].alias("y")))(geo.lambert_feet(p.y, p.x))
    plane = b.select("id", F.transform("box_ring", corner).alias("ring"))
    x, y = geo.ring_centroid(F.col("ring"))
    lat, lon = geo.from_lambert_feet(F.col("x"), F.col("y"))
    return plane.select("id", x.alias("x"), y.alias("y")).select("id", F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


CENTROIDS = f"SELECT id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM {BOXES_SQL}"


def plane_and_back(spark, sf):
    """Assets taken to the plane and back: places to seven digits, for which nothing may be lost."""
    x, y = geo.lambert_feet(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_lambert_feet(F.col("x"), F.col("y"))
    return _assets(spark, sf).select("id", x.alias("x"), y.alias("y")).select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


BACK = f"SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM {ASSETS}"

QUERIES = {"plane_centroids": (plane_centroids, CENTROIDS), "plane_and_back": (plane_and_back, BACK), "polygon_overlap": (polygon_overlap, OVERLAP), "overlap_rollup": (overlap_rollup, ROLLUP), "burnt_zones": (burnt_zones, BURNT), "union_share": (union_share, UNION), "simplified_borders": (simplified_borders, _borders_sql())}
