"""Whitening of embeddings by the eigenvectors of their covariance, which cyclic Jacobi rotations find.

1. Each entry c becomes the integer x = floor(SCALE * c) + SHIFT; equal vectors count once in the fit, so a vector that a third of all
   rows hold is one row after the grouping, which is combined before it is shuffled.
2. Two passes over the different vectors: exact integer sums, then the scatter of the centred ones. A task sends one row of the
   matrix for each dimension, and these are summed by dimension in tasks; the driver gets one matrix (dimensions squared).
3. The driver turns the matrix by symmetric Jacobi rotations, pair by pair, until what is off the diagonal vanishes beside the
   diagonal entries it belongs to; small eigenvalues come out as exactly as large ones. Sorted by eigenvalue, the scaled
   eigenvectors are broadcast (dimensions x components). A third pass measures the covariance of what they give.

Edge cases: rows whose vector is null, empty, or has a null, infinite or undefined entry are dropped; so are vectors of another length than
the one that most different vectors have (the longer of equals); entries beyond 2 ** 55 are undefined for this scale and count as
infinite. Components without variance have null in ``whitened`` (all of them if there is one vector), and ``explained`` is null
where no component has any; a deviation beyond 64 bits is null. Repeated rows are judged alike, rows without an id too; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 2.0**55

ROWS_SCHEMA = "vec_id long, size int, x binary"
WHITE_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- vectors


def _integers(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The rows that remain, and their vectors x as bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    x = np.floor(SCALE * values)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(x) < LARGEST)
    ends = np.cumsum(lengths)
    wrong = np.concatenate(([0], np.cumsum(bad)))
    stay = np.flatnonzero((lengths > 0) & (wrong[ends] == wrong[ends - lengths]))
    x = (np.where(bad, 0, x).astype(np.int64) + SHIFT).astype("<i8")
    return stay, [x[e - n : e].tobytes() for e, n in zip(ends[stay].tolist(), lengths[stay].tolist())]


def vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, size and x (64-bit integers as bytes) of each row that remains."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay, x = _integers(batch.column("c"))
            size = pa.array([len(v) // 8 for v in x], pa.int32())
            yield pa.record_batch([batch.column("vec_id").take(pa.array(stay)), size, pa.array(x, pa.binary())], names=["vec_id", "size", "x"])

    return rows.mapInArrow(convert, ROWS_SCHEMA)


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, size)


# ---------------------------------------------------------------- moments


def sums(fit: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch, size)
            # Halves of 32 bits: their sums over a batch stay below 2 ** 63.
            total += (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
            n += len(x)
        yield pa.record_batch({"dimension": pa.array([-1, *range(size)], pa.int32()), "total": pa.array([str(n), *map(str, total.tolist())])})

    parts = fit.select("x").mapInArrow(add, "dimension int, total string")
    found = {r.dimension: int(r.total) for r in parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(size)], object)


class Centre:
    """x - S / n, by whole numbers first: the nearest integer to the mean, then what is left of it."""

    def __init__(self, n: int, total: np.ndarray):
        self.n, self.total = n, total
        self.whole = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
        self.rest = np.array([(t - int(w) * n) / n for t, w in zip(total, self.whole)], float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2, exact; null beyond 64 bits."""
        left = [int(t) - int(w) * self.n for t, w in zip(self.total, self.whole)]
        near = x - self.whole
        most = float(self.n) * (float(np.abs(near).max(initial=0)) + 1)
        if len(left) * most * most < 2.0**62:
            return ((self.n * near - np.array(left, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, left)) for row in near.tolist()]
        return [v if v < 2**63 else None for v in exact]


def second_moments(fit: DataFrame, size: int, centre: Centre, projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the centred vectors, or of their projections."""
    spark = fit.sparkSession
    sent = spark.sparkContext.broadcast((centre, projection))
    wide = size if projection is None else projection.shape[1]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, turn = sent.value
        total = np.zeros((wide, wide))
        for batch in batches:
            z = middle(_matrix(batch, size))
            if turn is not None:
                z = z @ turn
            total += z.T @ z
        yield pa.record_batch({"dimension": pa.array(range(wide), pa.int32()), "products": pa.array([row.tobytes() for row in total], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, products in zip(batch.column("dimension").to_pylist(), batch.column("products").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(products)
        yield pa.record_batch({"dimension": pa.array(total, pa.int32()), "products": pa.array([row.tobytes() for row in total.values()], pa.binary())})

    schema = "dimension int, products binary"
    rows = fit.select("x").mapInArrow(scatter, schema).repartition(common.partitions(spark), "dimension").mapInArrow(merge, schema)
    out = np.zeros((wide, wide))
    for r in rows.collect():
        out[r.dimension] = np.frombuffer(r.products)
    return (out + out.T) / (2 * centre.n)


# ---------------------------------------------------------------- eigenvectors


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of a symmetric matrix, by cyclic rotations of pairs of rows and columns.

    A pair is turned while its entry is not negligible beside the geometric mean of its two diagonal entries; a sweep without
    any rotation ends the work.
    """
    a, vectors_ = np.array(matrix, float), np.eye(len(matrix))
    n = len(a)
    floor = np.finfo(float).tiny
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if off == 0 or abs(off) <= np.finfo(float).eps * math.sqrt(abs(a[p, p] * a[q, q])) or abs(off) < floor:
                    continue
                turned = True
                ratio = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1, ratio) / (abs(ratio) + math.hypot(1, ratio))
                c = 1 / math.hypot(1, t)
                s = t * c
                low, high = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[:, p], a[q], a[:, q] = row_p, row_p, row_q, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0, 0
                vectors_[:, p], vectors_[:, q] = c * vectors_[:, p] - s * vectors_[:, q], s * vectors_[:, p] + c * vectors_[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors_[:, order]


# ---------------------------------------------------------------- whitening


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each remaining row and component."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings, column)
    different = common.stored(rows.select("size", "x").distinct(), "vectors")
    sizes = different.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], WHITE_SCHEMA)
    size = sizes["size"]
    fit = different.where(F.col("size") == size)
    centre = Centre(*sums(fit, size))
    values, turn = jacobi(second_moments(fit, size, centre))
    trace, shown = float(values.sum()), min(components, size)
    alive = [i for i in range(shown) if values[i] > size * np.finfo(float).eps * values[0]]
    scaled = turn[:, alive] / np.sqrt(values[alive])
    error = float(np.abs(second_moments(fit, size, centre, scaled) - np.eye(len(alive))).max()) if alive else None
    explained = [float(v) / trace if trace > 0 else None for v in values[:shown]]
    sent = spark.sparkContext.broadcast((centre, scaled, alive, explained, error))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, turn, alive, explained, error = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, size)
            m = len(x)
            white, known = np.zeros((m, shown)), np.zeros((m, shown), bool)
            white[:, alive], known[:, alive] = middle(x) @ turn, True
            again = pa.array(np.repeat(np.arange(m), shown))
            columns = [
                batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)), pa.array(np.full(m * shown, middle.n)),
                pa.array(middle.deviations(x), pa.int64()).take(again), pa.array(white.ravel(), mask=~known.ravel()), pa.array(explained * m, pa.float64()), pa.array([error] * (m * shown), pa.float64()),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in WHITE_SCHEMA.split(", ")])

    return rows.where(F.col("size") == size).mapInArrow(project, WHITE_SCHEMA)


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
