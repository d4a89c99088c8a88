"""N-gram Jaccard join by chosen paths, with exact verification of what the paths bring together.

A document is its set of five-word shingles; documents with the same set share an id, and only sets are joined.

1. Paths. In each run a set of n shingles goes to the buckets of those shingles whose hash for the run is below
   1 / (SIMILARITY * n): 1.25 of them on average. Two sets with the wanted similarity share such a bucket with probability
   1 - 1/e or more. Where a bucket would hold more than BUCKET_MOST sets, its sets are split again on further sampled
   shingles, those aside that its path has already, MAX_DEPTH times at most. Of SIMILARITY * n shared shingles d are on the path, so
   that the next ones are sampled at 1 / (SIMILARITY * n - d), which keeps the probability of each level; the number of runs
   is such that a link at the deepest level is met with probability RECALL. What the sets of a path are, each document finds out by
   itself, from two filters of fixed size (buckets that two sets can reach, and buckets that are too large), so that documents
   are not shuffled.
2. Buckets become trees of sets that look alike (sketches of 64 bytes; estimated similarity of ALIKE or more, six deviations below the
   wanted one). Those that are still too large at the deepest level are dealt in blocks.
3. Trees become candidate groups, and these classes of true links, as ``setjoin`` says.

Every true link between two sets of one candidate group is found; that two linked sets are in one group has a probability of
RECALL at least.

Edge cases: a text of fewer than five words, but not none, is one shingle; a null or empty text has no links and is a class of
its own; repeated rows are copies like others; a class is named by its smallest doc_id, nulls aside; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, setjoin
from .anchors import bitmap, identified, passes, slots
from .automata import by_part
from .common import ALNUM, mix
from .setjoin import ID, TREE_SCHEMA, Sets, Shingles, components  # noqa: F401  (components belongs to this module's interface too)

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
ALIKE = 0.5
BUCKET_MOST = 1000
MAX_DEPTH = 3
SKETCH = 64
PARTS = 4  # for each shuffle partition

BUCKET_SCHEMA = "part int, key binary, sid binary, sketch binary"


def runs_needed(recall: float = RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs after which a link is met with probability `recall`; a path survives a level as in a Poisson branching process."""
    met = 1.0
    for _ in range(depth):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


# ---------------------------------------------------------------- paths


def sketches(sets: Sets, docs: np.ndarray) -> np.ndarray:
    """A byte of each of SKETCH minima, for the given texts."""
    n = sets.n[docs]
    flat = sets.shingles[common.ragged(sets.first[docs], n)]
    begin = np.cumsum(n) - n
    out = np.zeros((len(docs), SKETCH), np.uint8)
    for i in range(SKETCH if len(docs) else 0):
        out[:, i] = (mix(np.minimum.reduceat(flat * _odd(i, 1), begin)) & np.uint64(255)).astype(np.uint8)
    return out


def _odd(i: int, salt: int) -> np.uint64:
    """A multiplier for the i-th hash function."""
    return mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 + salt & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] | np.uint64(1)


def _limits(n: np.ndarray, similarity: float, depth: int) -> np.ndarray:
    """What a shingle's hash must stay below to be sampled at a depth, by the size of its set."""
    return (2.0**64 / np.maximum(similarity * n - depth, 1 if depth else similarity)).clip(max=2.0**64 - 2048).astype(np.uint64)


def paths(sets: Sets, similarity: float, runs: int, levels: list[tuple[np.ndarray, np.ndarray]], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket key, text) of each path.

    levels: for each level known so far, the filters of reachable and of too large buckets. With `last`, the buckets where paths
    end; else the keys of the next level, below the too large buckets of the last known one.
    """
    bound = _limits(sets.n, similarity, 0)[sets.doc]
    keys, ats = [], []
    for run in range(runs):
        at = np.flatnonzero(sets.shingles * _odd(run, 2) < bound)
        keys.append(mix(sets.shingles[at] ^ _odd(run, 3)))
        ats.append(at)
    key, at = np.concatenate(keys), np.concatenate(ats)
    doc, path = sets.doc[at], at[:, None]  # the shingles that each path has, by their places
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    for depth, (reachable, large) in enumerate(levels):
        met = passes(reachable, key)
        key, doc, path = key[met], doc[met], path[met]
        if depth == MAX_DEPTH - 1:
            break
        split = passes(large, key)
        ended.append((key[~split], doc[~split]))
        key, doc, path = key[split], doc[split], path[split]
        limit = _limits(sets.n, similarity, depth + 1)
        found = [(key[:0], path[:0, 0])]
        for k, odd, d, on in zip(key, mix(key) | np.uint64(1), doc.tolist(), path):
            first = sets.first[d]
            mine = sets.shingles[first : sets.first[d + 1]]
            sampled = mine * odd < limit[d]
            sampled[on - first] = False
            found.append((mix(mix(mine[sampled]) ^ k), np.flatnonzero(sampled) + first))
        many = [len(k) for k, _ in found[1:]]
        key, at = (np.concatenate(x) for x in zip(*found))
        path = np.concatenate((np.repeat(path, many, axis=0), at[:, None]), axis=1)
        doc = sets.doc[at]
    if not last:
        return key, doc
    ended.append((key, doc))
    return np.concatenate([k for k, _ in ended]), np.concatenate([d for _, d in ended])


# ---------------------------------------------------------------- candidate trees


def filters(rows: DataFrame, shingles: Shingles, similarity: float, runs: int, bucket_most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The filters of each level, until no bucket is too large or MAX_DEPTH is reached."""
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(MAX_DEPTH):
        sent = rows.sparkSession.sparkContext.broadcast(levels)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for _, sets in shingles.blocks(batches):
                slot, n = np.unique(slots(paths(sets, similarity, runs, sent.value, last=False)[0]), return_counts=True)
                yield pa.record_batch({"slot": pa.array(slot), "n": pa.array(n)})

        sums = common.stored(rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1"), "slots")
        large = sums.where(F.col("n") > bucket_most)
        levels.append((bitmap(sums), bitmap(large)))
        if not len(levels[-1][1]):
            break
    return levels


def buckets(rows: DataFrame, shingles: Shingles, similarity: float, runs: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The sets of all buckets, packed by part: keys, ids and sketches. Buckets that are too large have the part -1."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(levels)
    parts = PARTS * common.partitions(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set = set()  # of this task, so that copies are sent once; forgotten when large
        for _, sets in shingles.blocks(batches):
            key, doc = paths(sets, similarity, runs, sent.value, last=True)
            ids = sets.ids()
            marks = list(zip(key.tolist(), ids["a"][doc].tolist()))
            new = np.array([i for i, m in enumerate(marks) if m not in told and not told.add(m)], np.int64)
            if len(told) > 500_000:
                told.clear()
            key, doc = key[new], doc[new]
            part = np.where(passes(sent.value[-1][1], key), -1, (key % np.uint64(parts)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            key, doc, part = key[order], doc[order], part[order]
            some, which = np.unique(doc, return_inverse=True)
            sketch = sketches(sets, some)[which]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
            out = [(int(part[a]), key[a:b].tobytes(), ids[doc[a:b]].tobytes(), sketch[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            if out:
                yield pa.record_batch([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out))], names=["part", "key", "sid", "sketch"])

    return rows.mapInArrow(deal, BUCKET_SCHEMA)


def large_trees(packed: DataFrame, bucket_most: int) -> DataFrame:
    """Tree edges of the buckets that are still too large, in blocks."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = (np.frombuffer(row[c], f"V{width}").tolist() for c, width in (("sid", 16), ("sketch", SKETCH)))
                yield pa.record_batch([pa.array(np.frombuffer(row["key"], np.int64)), *[pa.array(r, pa.binary()) for r in rows]], names=["key", "sid", "sketch"])

    rows = common.stored(packed.mapInArrow(single, "key long, sid binary, sketch binary").dropDuplicates(["key", "sid"]), "large")
    sizes = common.stored(rows.groupBy("key").agg(F.count("*").alias("n")), "large-sizes")
    return setjoin.trees_in_blocks(rows.join(sizes, "key"), ALIKE, SKETCH, bucket_most)


def candidate_trees(rows: DataFrame, shingles: Shingles, similarity: float, recall: float, bucket_most: int) -> DataFrame:
    runs = runs_needed(recall)
    levels = filters(rows, shingles, similarity, runs, bucket_most)
    dealt, some_large = buckets(rows, shingles, similarity, runs, levels), len(levels[-1][1]) > 0
    if some_large:
        dealt = common.stored(dealt, "buckets")
    small = dealt.where("part >= 0").repartition(common.partitions(rows.sparkSession), "part").sortWithinPartitions("part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_part(batches):
            key, sid, sketch = (b"".join(r[c] for r in part) for c in ("key", "sid", "sketch"))
            yield setjoin.bucket_trees(np.frombuffer(key, np.uint64), np.frombuffer(sid, ID), np.frombuffer(sketch, np.uint8).reshape(-1, SKETCH), ALIKE)

    trees = small.mapInArrow(search, TREE_SCHEMA)
    return (trees.unionByName(large_trees(dealt.where("part < 0"), bucket_most)) if some_large else trees).distinct()


# ---------------------------------------------------------------- the join


def set_ids(rows: DataFrame, shingles: Shingles) -> DataFrame:
    """doc_id, text_hash, sid (null: no words) and n (shingles) of each document row; stored in the shared folder."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in shingles.blocks(batches):
            sid = [x.tobytes() if n else None for x, n in zip(sets.ids(), sets.n.tolist())]
            yield pa.record_batch([piece.column("doc_id"), piece.column("text_hash"), pa.array(sid, pa.binary()), pa.array(sets.n, pa.int64())], names=["doc_id", "text_hash", "sid", "n"])

    return common.stored(rows.mapInArrow(identify, "doc_id long, text_hash long, sid binary, n long"), "sets")


def join(documents: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, bucket_most: int = BUCKET_MOST, **blocks: int) -> DataFrame:
    """doc_id, text_hash, class_id, n_links (other rows of the wanted similarity), copies_id (the smallest doc_id with the same
    set) and root (the class; null without words) of each document row."""
    rows, shingles = identified(documents), Shingles(size, ALNUM.tobytes())
    members = set_ids(rows, shingles)
    return setjoin.linked(rows, members, candidate_trees(rows, shingles, similarity, recall, bucket_most), shingles, similarity, **blocks).drop("n")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents with one row of each class, that with the smallest doc_id; rows without words all stay."""
    return setjoin.one_of_each(documents, join(documents, **options))


def op5(spark, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


#: All pairs of documents that share a shingle; classes by recursion from each document to the smaller ones it reaches.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE links.a = reach.doc_id) AS n_links FROM reach GROUP BY doc_id
"""
