"""Near duplicates by fast similarity sketches, banding and exact verification.

1. Sketch. The shingles of a set are thrown into SKETCH bins, in rounds: each round hashes every shingle to a bin and a value, and a
   bin that was empty before keeps the smallest value of the round. After SKETCH rounds each further round has one bin of its own
   and throws all shingles there, so that every coordinate of every set is filled after twice as many rounds at most, and most
   sets need two or three. A coordinate of two sets agrees with the probability of their similarity, and the number of those that
   agree is concentrated about it as for independent minima.
2. Bands. BAND coordinates make a bucket's key; sets of the wanted similarity share none of SKETCH / BAND buckets with a
   probability of (1 - SIMILARITY ** BAND) ** (SKETCH / BAND), three in a million. Keys are counted first, combined before they are
   shuffled; sets with a key of their own go no further.
3. Buckets, groups and classes of exact links on the full sets are as ``setjoin`` says: sets of one bucket whose bytes of sketch
   show a similarity of ALIKE or more (six deviations below the wanted one) are candidates, and a large bucket is dealt in blocks.

Edge cases: a text of one word is one shingle of that word; a null text, or one without words, has no shingles, is linked with nothing
and a component of its own; repeated rows are copies like others; a component is named by its smallest doc_id, nulls aside;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, setjoin
from .anchors import identified
from .common import SPACED, mix
from .setjoin import Sets, Shingles

SHINGLE = 2
SIMILARITY = 0.8
SKETCH = 96
BAND = 4
ALIKE = 0.55
BUCKET_MOST = 1000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MEMBERS_SCHEMA = "doc_id long, text_hash long, sid binary, n long, bands array<long>, sketch binary"


def _seed(i: int) -> np.uint64:
    return mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def sketch(sets: Sets, size: int = SKETCH) -> tuple[np.ndarray, int]:
    """The coordinates of each text (those of texts without shingles stay empty), and the number of rounds."""
    out = np.full(len(sets.n) * size, _EMPTY)
    values, doc = sets.shingles, sets.doc
    for i in range(2 * size):
        if not len(values):
            return out.reshape(-1, size), i
        h = mix(values ^ _seed(i))
        # Within a bin the order of h is that of the rest of h.
        place = doc * size + ((h % np.uint64(size)).astype(np.int64) if i < size else i - size)
        free = out[place] == _EMPTY
        least = np.full(len(out), _EMPTY) if i == 0 else least
        np.minimum.at(least, place[free], h[free])
        filled = np.unique(place[free]) if i else np.flatnonzero(least != _EMPTY)
        # The round is part of a coordinate: values of different rounds are different.
        out[filled] = mix(least[filled] ^ _seed(i + 1)) & np.uint64(0x7FFFFFFFFFFFFFFF)
        open_ = (out.reshape(-1, size) == _EMPTY).any(1)[doc]
        values, doc = values[open_], doc[open_]
    return out.reshape(-1, size), 2 * size


def bands(coordinates: np.ndarray, band: int = BAND) -> np.ndarray:
    """A key for each run of `band` coordinates, its place included."""
    rows = coordinates.reshape(len(coordinates), -1, band)
    key = np.tile(np.array([_seed(i) for i in range(rows.shape[1])]), (len(rows), 1))
    for i in range(band):
        key = mix(key ^ rows[:, :, i])
    return key.view(np.int64)


def members_of(rows: DataFrame, shingles: Shingles, size: int, band: int) -> DataFrame:
    """doc_id, text_hash, sid (null: no words), n, bands and sketch (a byte of each coordinate) of each document row, stored."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in shingles.blocks(batches):
            coordinates, _ = sketch(sets, size)
            keys = bands(coordinates, band)
            some = sets.n > 0
            sid = pa.array([x.tobytes() if n else None for x, n in zip(sets.ids(), some.tolist())], pa.binary())
            per = np.where(some, keys.shape[1], 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array(keys[some].ravel()))
            marks = pa.array([row.tobytes() for row in (coordinates & np.uint64(255)).astype(np.uint8)], pa.binary())
            yield pa.record_batch([piece.column("doc_id"), piece.column("text_hash"), sid, pa.array(sets.n, pa.int64()), lists, marks], names=["doc_id", "text_hash", "sid", "n", "bands", "sketch"])

    return common.stored(rows.mapInArrow(place, MEMBERS_SCHEMA), "members")


def candidate_trees(members: DataFrame, size: int, bucket_most: int) -> DataFrame:
    """Tree edges u, v between sets that share a band and look alike."""
    sets = common.stored(members.where("sid IS NOT NULL").select("sid", "bands", "sketch").dropDuplicates(["sid"]), "sets")
    keys = sets.select(F.explode("bands").alias("key"), "sid")
    # Stored, so that adaptive execution can split the join with a hot key.
    shared = common.stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = keys.join(shared, "key").join(sets.select("sid", "sketch"), "sid")
    return setjoin.trees_in_blocks(met, ALIKE, size, bucket_most).distinct()


def near_duplicates(documents: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, coordinates: int = SKETCH, band: int = BAND, bucket_most: int = BUCKET_MOST, **blocks: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), class_id (the smallest doc_id that links reach), n_links, copies_id and root of each document row."""
    rows, shingles = identified(documents), Shingles(size, SPACED.tobytes())
    members = members_of(rows, shingles, coordinates, band)
    return setjoin.linked(rows, members.drop("bands", "sketch"), candidate_trees(members, coordinates, bucket_most), shingles, similarity, **blocks)


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents with one row of each component, that with the smallest doc_id; rows without words all stay."""
    return setjoin.one_of_each(documents, near_duplicates(documents, **options))


def op13(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_links")
