"""Thinning of rings that share borders, so that neighbours still meet and no ring crosses itself or another.

1. Nodes. Every side is an undirected edge with a signature of the rings that have it (a sum of hashes, combined before it is
   shuffled). A corner is a node if not just two edges meet there, or if its two edges have different rings.
2. Arcs. Each ring is cut at its nodes; an arc is written from its lesser end (a ring without nodes from its least corner, in the direction
   of the lesser neighbour), so that all rings that share it have the same arc, by the same key. Each arc is kept once.
3. Thinning. Each arc is thinned by itself (points within the tolerance of the line between those that stay go; a closed arc keeps three
   points at least). The thinned segments meet in grid cells: arcs that would cross, touch or overlap another or themselves beside common
   ends are thinned anew with a fourth of their tolerance, LEVELS times at most, and then kept whole. This ends, since both arcs
   of a conflict are refined.
4. Rings are put together again from the arcs.

Edge cases: null rings, and rings of fewer than three different corners, are left out; a ring need not be closed by its first corner, and a
corner repeated in a row counts once; equal rings stay equal; an empty table gives no rows. Rings that cross in the input may cross in
the output; a small ring that lies in a bay narrower than the tolerance may come to lie inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .raster import _kept

LEVELS = 6
_POINTS = "array<struct<x:double,y:double>>"
ARCS_SCHEMA = "ring_key long, arc int, key string, forward boolean, x array<double>, y array<double>"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- arcs


def _corners(rings: DataFrame) -> DataFrame:
    """ring_key, pos, x, y and the next corner of each ring (id, ring), without repeated and missing corners."""
    known = F.filter(F.col("ring").cast(_POINTS), lambda p: p.isNotNull() & p.x.isNotNull() & p.y.isNotNull())
    apart = F.filter(F.transform(known, lambda p, i: F.struct(p.x.alias("x"), p.y.alias("y"), i.alias("i"))), lambda p: (p.i == 0) | (F.get("known", p.i - 1).x != p.x) | (F.get("known", p.i - 1).y != p.y))
    with_ring = rings.withColumn("known", known).withColumn("open", apart)
    last = F.element_at("open", -1)
    closed = (F.size("open") > 1) & (last.x == F.get("open", F.lit(0)).x) & (last.y == F.get("open", F.lit(0)).y)
    opened = with_ring.withColumn("open", F.when(closed, F.slice("open", 1, F.greatest(F.size("open") - 1, F.lit(1)))).otherwise(F.col("open")))
    enough = opened.where(F.size(F.array_distinct(F.transform("open", lambda p: F.struct(p.x, p.y)))) >= 3)
    following = F.concat(F.slice("open", 2, F.size("open")), F.slice("open", 1, 1))
    sides = F.zip_with("open", following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    each = enough.select("ring_key", F.posexplode(sides).alias("pos", "s"))
    return each.select("ring_key", "pos", *[F.col(f"s.{a}.{c}").alias(f"{c}{n}") for n, a in (("", "p"), ("2", "q")) for c in "xy"])


def _nodes(corners: DataFrame) -> DataFrame:
    """x, y of the corners at which arcs end."""
    turned = F.struct("x", "y") <= F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    ends = [F.when(turned, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("ax", "x", "x2"), ("ay", "y", "y2"), ("bx", "x2", "x"), ("by", "y2", "y"))]
    edges = corners.select("ring_key", *ends).groupBy("ax", "ay", "bx", "by").agg(F.sum(F.xxhash64("ring_key").cast("decimal(20,0)")).alias("rings"))
    at = edges.select("rings", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    return at.groupBy("p.x", "p.y").agg(F.count("*").alias("n"), F.min("rings").alias("a"), F.max("rings").alias("b")).where("n <> 2 OR a <> b").select("x", "y", F.lit(True).alias("node"))


def _cut(ring_key: int, corners: list[dict]) -> Iterator[tuple]:
    """The arcs of a ring: (ring_key, number, key, forward, x, y)."""
    p = [(c["x"], c["y"]) for c in corners]
    nodes = [i for i, c in enumerate(corners) if c["node"]]
    if not nodes:
        # From the least corner, towards the lesser neighbour.
        i = min(range(len(p)), key=lambda k: p[k])
        arcs = [p[i:] + p[: i + 1]]
    else:
        turned = p[nodes[0] :] + p[: nodes[0] + 1]
        cuts = [k - nodes[0] for k in nodes] + [len(p)]
        arcs = [turned[a : b + 1] for a, b in zip(cuts, cuts[1:])]
    for number, arc in enumerate(arcs):
        forward = (arc[0], arc[1]) <= (arc[-1], arc[-2])
        written = arc if forward else arc[::-1]
        x, y = [c[0] for c in written], [c[1] for c in written]
        yield ring_key, number, hashlib.sha256(np.array(written).tobytes()).hexdigest(), forward, x, y


def arcs(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs of each ring in order (ring_key, arc, key, forward), and each arc once (key, x, y)."""
    corners = _stored(_corners(rings), "corners")
    flagged = corners.select("ring_key", "pos", "x", "y").join(_nodes(corners), ["x", "y"], "left").withColumn("node", F.coalesce("node", F.lit(False)))
    whole = flagged.groupBy("ring_key").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "node"))).alias("corners"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [a for key, c in zip(batch.column("ring_key").to_pylist(), batch.column("corners").to_pylist()) for a in _cut(key, c)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*found) if found else [[]] * 6, kinds)], names=["ring_key", "arc", "key", "forward", "x", "y"])

    every = _stored(whole.mapInArrow(cut, ARCS_SCHEMA), "arcs")
    return every.select("ring_key", "arc", "key", "forward"), every.select("key", "x", "y").dropDuplicates(["key"])


# ---------------------------------------------------------------- thinning


def thinned(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an arc stay."""
    if x[0] != x[-1] or y[0] != y[-1]:
        return _kept(x, y, tolerance)
    # A closed arc is cut at the point farthest from its end, and the point farthest from that chord stays too.
    far = int(np.hypot(x - x[0], y - y[0]).argmax())
    keep = np.zeros(len(x), bool)
    keep[: far + 1] |= _kept(x[: far + 1], y[: far + 1], tolerance)
    keep[far:] |= _kept(x[far:], y[far:], tolerance)
    if keep.sum() < 4:
        keep[int(np.abs((x - x[0]) * (y[far] - y[0]) - (y - y[0]) * (x[far] - x[0])).argmax())] = True
    return keep


def _thin(rows: DataFrame, tolerance: float) -> DataFrame:
    """The arcs (key, level, x, y), thinned to a fourth of the tolerance for each level; those of level LEVELS stay whole."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for level, x, y in zip(*(batch.column(c).to_pylist() for c in ("level", "x", "y"))):
                x, y = np.array(x), np.array(y)
                keep = thinned(x, y, tolerance / 4**level) if level < LEVELS else np.ones(len(x), bool)
                xs.append(x[keep])
                ys.append(y[keep])
            lists = [pa.array(v, pa.list_(pa.float64())) for v in (xs, ys)]
            yield pa.record_batch([batch.column("key"), batch.column("level"), *lists], names=["key", "level", "x", "y"])

    return rows.select("key", "level", "x", "y").mapInArrow(thin, "key string, level int, x array<double>, y array<double>")


def conflicts(thin: DataFrame, cell: float) -> DataFrame:
    """key of the arcs with segments that meet others elsewhere than at a common end of both."""
    at = F.expr("posexplode(transform(sequence(1, size(x) - 1), i -> struct(x[i - 1] AS x1, y[i - 1] AS y1, x[i] AS x2, y[i] AS y2)))").alias("i", "s")
    segments = thin.select("key", "level", at).select("key", "level", "i", "s.*")
    box = {f"{f}{c}": g(F.col(f"{c}1"), F.col(f"{c}2")) for c in "xy" for f, g in (("low", F.least), ("top", F.greatest))}
    grid = lambda c: F.floor(c / F.lit(cell)).cast("long")
    boxed = segments.select("*", *[v.alias(k) for k, v in box.items()])
    spread = boxed.withColumn("cx", F.explode(F.sequence(grid(F.col("lowx")), grid(F.col("topx"))))).withColumn("cy", F.explode(F.sequence(grid(F.col("lowy")), grid(F.col("topy")))))
    a, b = (spread.select("cx", "cy", *[F.col(c).alias(f"{n}_{c}") for c in ("key", "level", "i", "x1", "y1", "x2", "y2", "lowx", "topx", "lowy", "topy")]) for n in "ab")
    pairs = a.join(b, ["cx", "cy"]).where("struct(a_key, a_i) < struct(b_key, b_i) AND a_lowx <= b_topx AND b_lowx <= a_topx AND a_lowy <= b_topy AND b_lowy <= a_topy")
    turn = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    (a1, a2), (b1, b2) = ([(f"{n}_x{k}", f"{n}_y{k}") for k in (1, 2)] for n in "ab")
    o = [turn(*t) for t in ((a1, a2, b1), (a1, a2, b2), (b1, b2, a1), (b1, b2, a2))]
    within = lambda p, q, r: f"({r[0]} BETWEEN least({p[0]}, {q[0]}) AND greatest({p[0]}, {q[0]}) AND {r[1]} BETWEEN least({p[1]}, {q[1]}) AND greatest({p[1]}, {q[1]}))"
    equal = lambda p, q: f"({p[0]} = {q[0]} AND {p[1]} = {q[1]})"
    cross = f"({o[0]} * {o[1]} < 0 AND {o[2]} * {o[3]} < 0)"
    # An end that lies on the other segment, other than as one of its ends.
    touch = " OR ".join(f"({side} = 0 AND {within(*on, p)} AND NOT {equal(p, on[0])} AND NOT {equal(p, on[1])})" for side, on, p in zip(o, ((a1, a2), (a1, a2), (b1, b2), (b1, b2)), (b1, b2, a1, a2)))
    same = f"({equal(a1, b1)} AND {equal(a2, b2)}) OR ({equal(a1, b2)} AND {equal(a2, b1)})"
    bad = pairs.where(f"(a_level < {LEVELS} OR b_level < {LEVELS}) AND ({cross} OR {touch} OR {same})")
    return bad.select(F.explode(F.array("a_key", "b_key")).alias("key")).distinct()


def simplified_together(rings: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """id, ring (closed, struct(x, y)) of each ring (id, ring), thinned by arcs; cell: side of the grid in which segments meet."""
    keyed = _stored(rings.select("id", F.col("ring").cast(_POINTS).alias("ring")).withColumn("ring_key", F.xxhash64("id", F.to_json("ring"))), "rings")
    parts, each = arcs(keyed.dropDuplicates(["ring_key"]))
    now = _stored(each.withColumn("level", F.lit(0)), "levels")
    for _ in range(LEVELS + 1):
        thin = _stored(_thin(now, tolerance), "thin")
        bad = _stored(conflicts(thin, cell), "bad")
        if bad.isEmpty():
            break
        refined = F.when(F.col("worse"), F.least(F.col("level") + 1, F.lit(LEVELS))).otherwise(F.col("level"))
        now = _stored(now.join(bad.withColumn("worse", F.lit(True)), "key", "left").withColumn("level", refined).drop("worse"), "levels")
    points = F.arrays_zip("x", "y")
    ordered = parts.join(thin.select("key", points.alias("points")), "key").withColumn("points", F.when(F.col("forward"), F.col("points")).otherwise(F.reverse("points")))
    joined = ordered.groupBy("ring_key").agg(F.array_sort(F.collect_list(F.struct("arc", "points"))).alias("arcs"))
    ends = F.flatten(F.transform("arcs", lambda a: F.slice(a.points, 1, F.size(a.points) - 1)))
    back = joined.select("ring_key", F.concat(ends, F.slice(ends, 1, 1)).cast(_POINTS).alias("thin"))
    return keyed.join(back, "ring_key").select("id", F.col("thin").alias("ring"))
