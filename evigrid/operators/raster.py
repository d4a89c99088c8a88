"""Raster operators on tables of cells (row, col, value): tiles, filling of gaps, connected areas, outlines' simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(cells: DataFrame, size: int) -> DataFrame:
    """A row for each tile: its number by row and column, and its cells as sorted arrays of place and value."""
    place = (F.col("row") % size * size + F.col("col") % size).cast("int")
    packed = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("value").cast("double").alias("value"))))
    return cells.groupBy((F.col("row") / size).cast("long").alias("tile_row"), (F.col("col") / size).cast("long").alias("tile_col")).agg(packed.alias("cells"))


def filled(cells: DataFrame, largest: int = 5) -> DataFrame:
    """Cells without a value take the mean of the smallest square around them (3 x 3 to 11 x 11) that has any."""
    gaps = cells.where("value IS NULL OR isnan(value)").select("row", "col")
    known = cells.where("value IS NOT NULL AND NOT isnan(value)")
    offsets = F.sequence(F.lit(-largest), F.lit(largest))
    around = gaps.withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets)).select(F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col"), F.greatest(F.abs("dy"), F.abs("dx")).alias("d"))
    met = around.join(known, ["row", "col"]).groupBy("r", "c").agg(*[F.avg(F.when(F.col("d") <= k, F.col("value"))).alias(f"m{k}") for k in range(1, largest + 1)])
    new = met.select(F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce(*[f"m{k}" for k in range(1, largest + 1)]).alias("new"))
    return cells.join(new, ["row", "col"], "left").select("row", "col", F.when(F.col("value").isNull() | F.isnan("value"), F.col("new")).otherwise(F.col("value")).alias("value"))


#: Tiles whose cells are Python's at once.
TILES = 64


def _grids(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each tile of a batch: its row, and the values of its grid, NaN where there is none, with the number of its cells."""
    for first in range(0, batch.num_rows, TILES):
        cells = batch.column("cells").slice(first, TILES)
        flat, n = cells.flatten(), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
        place = pc.struct_field(flat, "place").to_numpy(zero_copy_only=False)
        value = pc.struct_field(flat, "value").to_numpy(zero_copy_only=False).astype(np.float64)
        grid = np.full((len(n), size * size), np.nan)
        known = ~np.isnan(value)
        grid[np.repeat(np.arange(len(n)), n)[known], place[known].astype(np.int64)] = value[known]
        for i in range(len(n)):
            yield first + i, grid[i], n[i]


def labelled(wet: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected areas of a grid of flags, 0 where it is not set: labels spread until none changes."""
    label = np.where(wet, np.arange(1, wet.size + 1).reshape(wet.shape), 0)
    while True:
        near = np.pad(label, 1)
        best = np.maximum.reduce([near[1:-1, 1:-1], near[:-2, 1:-1], near[2:, 1:-1], near[1:-1, :-2], near[1:-1, 2:]])
        new = np.where(wet, best, 0)
        # Jump to the label of the cell a label names: halves the rounds of long areas.
        new = np.where(wet, np.maximum(new, np.concatenate(([0], new.ravel()))[new]), 0)
        if (new == label).all():
            return label
        label = new


def areas(tiles: DataFrame, size: int, least: float) -> DataFrame:
    """Of each tile: the share of cells of value `least` or more, and the number and largest size of their 4-connected areas."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, grid, cells in _grids(batch, size):
                wet = (grid >= least).reshape(size, size)
                _, n = np.unique(labelled(wet)[wet], return_counts=True)
                rows.append((wet.sum() / max(cells, 1), len(n), int(n.max(initial=0))))
            share, areas_, largest = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.float64, np.int64, np.int64)))
            yield pa.record_batch([batch.column("tile_row"), batch.column("tile_col"), pa.array(share), pa.array(areas_), pa.array(largest)], names=["tile_row", "tile_col", "share", "areas", "largest"])

    return tiles.mapInArrow(measure, "tile_row long, tile_col long, share double, areas long, largest long")


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the points of a line that are needed to stay within the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = np.hypot(dx, dy)
        off = np.abs(px * dy - py * dx) / length if length else np.hypot(px, py)
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplified(rows: DataFrame, ring: str, tolerance: float) -> DataFrame:
    """The rows with the rings of a column (struct(x, y)) thinned: points within the tolerance of the line between those that stay go."""

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for points in frame[ring]:
                if points is not None and len(points) >= 4:
                    keep = _kept(np.array([p["x"] for p in points]), np.array([p["y"] for p in points]), tolerance)
                    points = [p for p, stays in zip(points, keep) if stays]
                out.append(points)
            yield frame.assign(**{ring: out})

    return rows.mapInPandas(thin, rows.schema)


def traced(inside: np.ndarray) -> list[list[tuple[int, int]]]:
    """The rings around the set cells of a grid, by corners (row, col): outer ones clockwise, holes the other way."""
    padded = np.pad(inside, 1)
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    # A side lies between a set cell and one that is not; it is walked with the set cell on its right.
    for (dr, dc), (a, b) in {(-1, 0): ((0, 0), (0, 1)), (0, 1): ((0, 1), (1, 1)), (1, 0): ((1, 1), (1, 0)), (0, -1): ((1, 0), (0, 0))}.items():
        open_ = inside & ~padded[1 + dr : 1 + dr + inside.shape[0], 1 + dc : 1 + dc + inside.shape[1]]
        for r, c in np.argwhere(open_).tolist():
            ahead.setdefault((r + a[0], c + a[1]), []).append((r + b[0], c + b[1]))
    rings = []
    while ahead:
        start = at = min(ahead)
        ring, step = [start], (0, 0)
        while True:
            choices = ahead[at]
            # Where two cells touch at a corner, turn right: areas are joined by sides only.
            right = (at[0] + step[1], at[1] - step[0])
            to = right if right in choices else choices[0]
            choices.remove(to)
            if not choices:
                del ahead[at]
            new = (to[0] - at[0], to[1] - at[1])
            if new == step:
                ring[-1] = to
            else:
                ring.append(to)
            at, step = to, new
            if at == start:
                break
        rings.append(ring)
    return rings


_OUTLINES = pa.schema([(c, pa.int64()) for c in ("tile_row", "tile_col", "class", "cells")] + [("rings", pa.list_(pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))))])


def outlines(tiles: DataFrame, size: int, drop: tuple[int, ...] = (0,), least: int = 1) -> DataFrame:
    """Polygons of a raster of classes: tile_row, tile_col, class, cells and rings (corners x: column, y: row) of each 4-connected
    area of one class within a tile, but for dropped classes and areas of fewer than `least` cells."""
    schema = "tile_row long, tile_col long, class long, cells long, rings array<array<struct<x:long,y:long>>>"

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(c).to_numpy().tolist() for c in ("tile_row", "tile_col")]
            rows: list[dict] = []
            for i, values, _ in _grids(batch, size):
                tile_row, tile_col = at[0][i], at[1][i]
                grid = np.where(np.isnan(values), drop[0] if drop else -1, np.nan_to_num(values)).astype(np.int64).reshape(size, size)
                for value in np.setdiff1d(np.unique(grid), drop).tolist():
                    label = labelled(grid == value)
                    for number, n in zip(*np.unique(label[label > 0], return_counts=True)):
                        if n >= least:
                            rings = [[{"x": tile_col * size + c, "y": tile_row * size + r} for r, c in ring] for ring in traced(label == number)]
                            rows.append({"tile_row": tile_row, "tile_col": tile_col, "class": value, "cells": int(n), "rings": rings})
                if len(rows) >= TILES:
                    yield pa.RecordBatch.from_pylist(rows, _OUTLINES)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _OUTLINES)

    return tiles.mapInArrow(trace, schema)
