"""Approximate nearest vectors: inverted lists, product-quantised codes, asymmetric distance tables and exact re-ranking.

``fit`` sees a sample of at most about FIT_MOST vectors (those whose id hashes lowest), taken to the driver: k-means gives the centres
of the lists, and of each group of dimensions the codewords of what is left of a vector beside its centre. How many lists a query
visits is measured on the sample: the fewest that hold the true neighbours of its probes with a share of VISITED.
``build`` puts every vector into the list of its centre, as codes of a byte for each group, in stored rows of LIST_BLOCK vectors at most: a
list that a third of all vectors fall into is many rows. ``search`` sends each query to its lists, in blocks; a task looks the distances
of all vectors of a row up in tables of (query, group, codeword), and passes on the CANDIDATES nearest of each query, which are merged
by query, joined with their vectors and ranked by exact cosine.

Edge cases: rows without an id or a vector, with an undefined or infinite entry, or with another length than most of the sample are not
indexed and find nothing; a zero vector has similarity 0 to all; equal vectors are ranked by id; an empty table has no index rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .spatial import top_n

FIT_MOST = 65_536
LISTS_MOST = 32_768
GROUP_DIMENSIONS = 4
VISITED = 0.95
LIST_BLOCK, QUERY_BLOCK = 4096, 256
#: Shards of the stored lists, vectors of a shard (but for small tables), and the tasks of a shard by queries: ASKED_MOST of them at most.
SHARDS, SHARD_VECTORS, PARTS, ASKED_MOST = 16, 1 << 19, 4, 16_384
CANDIDATES = 100


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def closest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first; in steps, so that a few million distances are held at once."""
    step = max(1, (1 << 22) // max(1, len(centres)))
    found = [np.zeros((0, k), np.int64)]
    for i in range(0, len(x), step):
        far = distances(x[i : i + step], centres)
        found.append(far.argmin(1)[:, None] if k == 1 else np.argsort(far, axis=1, kind="stable")[:, :k])
    return np.concatenate(found)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return closest(x, centres, 1)[:, 0]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from k different rows, spread evenly; a centre that loses all its rows moves to the farthest row."""
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    centres = different[np.random.default_rng(0).permutation(len(different))[:k]]
    for _ in range(rounds):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        lost = np.flatnonzero(n == 0)
        if len(lost):
            centres[lost] = x[np.argsort(-((x - centres[of]) ** 2).sum(1), kind="stable")[: len(lost)]]
    return centres


# ---------------------------------------------------------------- the index


@dataclass
class Quantiser:
    """What queries and vectors are measured with: list centres, codewords of each group of dimensions, lists to visit."""

    size: int
    centres: np.ndarray
    words: list[np.ndarray]
    visits: int
    n: int = 0

    def groups(self) -> list[slice]:
        return [slice(i, min(i + GROUP_DIMENSIONS, self.size)) for i in range(0, self.size, GROUP_DIMENSIONS)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and the codeword of each group."""
        of = nearest(x, self.centres)
        left = x - self.centres[of]
        return of, np.stack([nearest(left[:, g], w) for g, w in zip(self.groups(), self.words)], 1).astype(np.uint8)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return closest(x, self.centres, self.visits)

    def tables(self, x: np.ndarray, list_: int) -> np.ndarray:
        """Squared distances (query, group, codeword) from codewords placed about the centre of a list."""
        left = x - self.centres[list_]
        out = np.full((len(x), len(self.words), 256), np.inf)
        for i, (g, w) in enumerate(zip(self.groups(), self.words)):
            out[:, i, : len(w)] = distances(left[:, g], w)
        return out


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that have both, with finite entries only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return normalised(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def fit(vectors: DataFrame, lists: int | None = None, most: int = FIT_MOST) -> Quantiser | None:
    """Centres and codewords from a sample; as many lists as the square root of the table has, unless given. None for an empty table."""
    rows = _clean(vectors)
    n = rows.count()
    if not n:
        return None
    sample = rows if n <= most else rows.where(F.xxhash64("vec_id").cast("double") < -(2.0**63) + 2.0**64 * most / n)
    found = [np.array(r.embedding) for r in sample.orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    size = max(sorted({len(v) for v in found}, reverse=True), key=lambda s: sum(len(v) == s for v in found))
    x = normalised(np.array([v for v in found if len(v) == size]))
    centres = k_means(x, min(lists or math.isqrt(n), LISTS_MOST, len(x)))
    left = x - centres[nearest(x, centres)]
    made = Quantiser(size, centres, [], len(centres), n)
    made.words = [k_means(left[:, g], 256) for g in made.groups()]
    made.visits = visits_needed(x, centres)
    return made


def visits_needed(x: np.ndarray, centres: np.ndarray, k: int = 10, probes: int = 200) -> int:
    """The fewest lists that hold VISITED of the k true neighbours (in the sample) of the first rows of a sample."""
    asked = x[:probes]
    far = distances(asked, x)
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = np.argsort(far, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(closest(asked, centres, len(centres)), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(x, centres)[true], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(VISITED * len(needed)))]) if len(needed) else 1


BLOCK_SCHEMA = "list int, ids binary, codes binary"


def build(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """Stores every vector in its list: rows of (list, ids, codes), LIST_BLOCK vectors at most."""
    spark, sent = vectors.sparkSession, vectors.sparkSession.sparkContext.broadcast(quantiser)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, codes = sent.value.encode(_matrix(batch.column("embedding"), sent.value.size))
            yield pa.record_batch([pa.array(of.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "vec_id", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
            codes = batch.column("code").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, int)
            spans = [(a, min(a + LIST_BLOCK, e)) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for a in range(s, e, LIST_BLOCK)]
            columns = [pa.array([int(of[a]) for a, _ in spans], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([b"".join(codes[a:b]) for a, b in spans], pa.binary())]
            yield pa.record_batch(columns, names=["list", "ids", "codes"])

    placed = _clean(vectors).where(F.size("embedding") == quantiser.size).mapInArrow(place, "list int, vec_id long, code binary")
    # Dealt by list and id, so that no task gets a hot list whole.
    dealt = placed.repartition(F.col("list"), F.pmod(F.xxhash64("vec_id"), F.lit(16))).sortWithinPartitions("list", "vec_id")
    path = new_path(spark, "vector-lists")
    dealt.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(path)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


# ---------------------------------------------------------------- search


def search(blocks: DataFrame, quantiser: Quantiser, vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """query, vec_id, score (cosine, nine digits) and rank of the k most similar vectors, the query itself aside; queries: vec_id, embedding."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)
    asked = _clean(queries).where(F.size("embedding") == quantiser.size)

    shards, parts = max(SHARDS, -(-quantiser.n // SHARD_VECTORS)), max(PARTS, -(-asked.count() // ASKED_MOST))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), sent.value.size)
            visited = np.zeros((len(x), len(sent.value.centres)), bool)
            np.put_along_axis(visited, sent.value.lists(x), True, 1)
            yield pa.record_batch([batch.column("vec_id"), *(pa.array([v.tobytes() for v in m], pa.binary()) for m in (x, np.packbits(visited, axis=1)))], names=["vec_id", "data", "visited"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    routed = asked.mapInArrow(route, "vec_id long, data binary, visited binary").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("shard", every(shards))
    stored = blocks.withColumn("shard", F.pmod(F.xxhash64("list", "ids"), F.lit(shards)).cast("int")).withColumn("part", every(parts))

    def look_up(lists: pa.Table, queries: pa.Table) -> pa.Table:
        names = queries.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(queries.column("data").to_pylist())).reshape(len(names), sent.value.size)
        visited = np.frombuffer(b"".join(queries.column("visited").to_pylist()), np.uint8).reshape(len(names), -1)
        best, at = np.full((len(names), candidates), np.inf), np.zeros((len(names), candidates), np.int64)
        for of, held, coded in zip(*(lists.column(c).to_pylist() for c in ("list", "ids", "codes"))):
            ids = np.frombuffer(held, np.int64)
            codes = np.frombuffer(coded, np.uint8).reshape(len(ids), -1)
            asking = np.flatnonzero(visited[:, of >> 3] >> (7 - (of & 7)) & 1)
            for q in (asking[i : i + QUERY_BLOCK] for i in range(0, len(asking), QUERY_BLOCK)):
                tables = sent.value.tables(x[q], of)
                far = np.zeros((len(q), len(ids)))
                for g in range(codes.shape[1]):
                    far += tables[:, g, :][:, codes[:, g]]
                far[names[q][:, None] == ids[None, :]] = np.inf
                far, who = np.concatenate((best[q], far), 1), np.concatenate((at[q], np.broadcast_to(ids, far.shape)), 1)
                first = np.argpartition(far, candidates - 1, axis=1)[:, :candidates]
                best[q], at[q] = np.take_along_axis(far, first, 1), np.take_along_axis(who, first, 1)
        known = np.isfinite(best)
        return pa.table({"query": pa.array(np.repeat(names, candidates)[known.ravel()]), "vec_id": pa.array(at[known]), "far": pa.array(best[known])})

    met = stored.groupBy("shard", "part").cogroup(routed.groupBy("shard", "part")).applyInArrow(look_up, "query long, vec_id long, far double")
    near = top_n(met, ["query"], [F.col("far"), F.col("vec_id")], candidates).select("query", "vec_id")
    clean = _clean(vectors)
    pairs = near.join(clean, "vec_id").join(asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked")), "query")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot("asked", "asked")) * F.sqrt(dot("embedding", "embedding"))
    scored = pairs.select("query", "vec_id", F.round(F.when(length > 0, dot("asked", "embedding") / length).otherwise(0.0), 9).alias("score"))
    return top_n(scored, ["query"], [F.desc("score"), F.col("vec_id")], k)


def scanned_share(blocks: DataFrame, quantiser: Quantiser, queries: DataFrame) -> float:
    """The share of all (query, vector) pairs whose codes a search looks at."""
    sizes = np.zeros(len(quantiser.centres), np.int64)
    for r in blocks.groupBy("list").agg(F.sum(F.length("ids") / 8).cast("long").alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r.n
    spark: SparkSession = blocks.sparkSession
    sent = spark.sparkContext.broadcast((quantiser, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, n = sent.value
            seen = n[made.lists(_matrix(batch.column("embedding"), made.size))].sum(1)
            yield pa.record_batch({"seen": pa.array(seen)})

    asked = _clean(queries).where(F.size("embedding") == quantiser.size)
    found = asked.mapInArrow(count, "seen long").agg(F.sum("seen").alias("seen"), F.count("*").alias("n")).first()
    return (found.seen or 0) / max(1, found.n * int(sizes.sum()))
