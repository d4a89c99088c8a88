"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

How many pieces there are of each length is all that packing needs: at most ``capacity`` numbers, whatever the size of
the corpus. The driver reduces that histogram (sets of up to three pieces that dominate all others with the same longest
piece are fixed for good, in bulk), packs the remainder by best fit in decreasing order, also in bulk, and so gets
patterns: lists of lengths, with how many sequences follow each. A piece finds its sequence by its rank among the pieces
of its length, which comes from counts by (partition, length); so no task holds all pieces of a length.

Edge cases: null and empty texts are one piece that holds the end id; repeated rows are packed one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import PIECE_BYTES, encoder, vocabulary_path

CAPACITY = 2048
PIECES_SCHEMA = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank_in_part long"


# ---------------------------------------------------------------- packing of a histogram


class Counts:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def at_most(self, length: int) -> int | None:
        i = bisect.bisect_right(self.lengths, length)
        return self.lengths[i - 1] if i else None

    def smallest(self, k: int, over: int = 0) -> list[int]:
        """The k smallest pieces longer than `over`; fewer if there are not so many."""
        found: list[int] = []
        for length in self.lengths[bisect.bisect_right(self.lengths, over) :]:
            found += [length] * min(k - len(found), self.n[length])
            if len(found) == k:
                break
        return found


def _best_pair(left: Counts, room: int) -> tuple[int, int] | None:
    """Two pieces with the largest sum within room, the first not shorter."""
    best = None
    low, high = 0, len(left.lengths) - 1
    while low <= high:
        a, b = left.lengths[low], left.lengths[high]
        if a + b > room or (low == high and left.n[a] < 2):
            high -= 1
            continue
        if best is None or a + b > sum(best):
            best = (b, a)
        low += 1
    return best


def _dominating(left: Counts, length: int, capacity: int) -> list[int] | None:
    """Companions of a piece (taken out of `left`) in a set of at most three that dominates all sets with it."""
    room = capacity - length
    partner = left.at_most(room)
    if partner is None:
        return []
    if partner == room:
        return [partner]
    few = left.smallest(3)
    if len(few) < 2 or few[0] + few[1] > room:
        return [partner]
    if len(few) == 3 and sum(few) <= room:
        return None  # four pieces fit together: not decided by sets of three
    pair = _best_pair(left, room)
    if pair is None or sum(pair) <= partner:
        return [partner]
    if pair[0] == partner:
        over = left.smallest(2, pair[1])
        if len(over) < 2 or sum(over) > room:
            return list(pair)
    return None


def reduce_by_dominance(left: Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Fixes dominating sets as long as there are any; returns (lengths, how many times)."""
    fixed: list[tuple[list[int], int]] = []
    changed = True
    while changed:
        changed = False
        for length in left.lengths[::-1]:
            while left.n.get(length):
                left.take(length, 1)
                partners = _dominating(left, length, capacity)
                if partners is None:
                    left.n[length] = left.n.get(length, 0) + 1
                    if length not in left.lengths:
                        bisect.insort(left.lengths, length)
                    break
                # The same set stays dominant while its lengths last: fewer other pieces mean fewer rivals.
                wanted = {x: ([length, *partners].count(x)) for x in {length, *partners}}
                have = {x: left.n.get(x, 0) + (x == length) for x in wanted}
                times = max(1, min(have[x] // wanted[x] for x in wanted))
                for x, k in wanted.items():
                    if k * times - (x == length):
                        left.take(x, k * times - (x == length))
                fixed.append(([length, *partners], times))
                changed = True
    return fixed


def best_fit(left: Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit in decreasing order; sequences with the same contents are filled together."""
    open_by_room: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[list[int], int]] = []

    def put(contents: list[int], times: int, room: int) -> None:
        if times and room:
            if room not in open_by_room:
                open_by_room[room] = []
                bisect.insort(rooms, room)
            open_by_room[room].append((contents, times))
        elif times:
            done.append((contents, times))

    for length in left.lengths[::-1]:
        n = left.n[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                room, contents, times = capacity, [], -(-n // (capacity // length))
            else:
                room = rooms[i]
                contents, times = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(i)
            each = room // length
            full = min(times, n // each)
            put(contents + [length] * each, full, room - each * length)
            n -= full * each
            times -= full
            if times and 0 < n < each:
                put(contents + [length] * n, 1, room - n * length)
                n, times = 0, times - 1
            put(contents, times if contents else 0, room)
    return done + [x for group in open_by_room.values() for x in group]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, how many such sequences) that hold all pieces."""
    left = Counts(counts)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, sequence of the first rank, offset): pieces of a length, by rank, to places."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return out


# ---------------------------------------------------------------- Spark side


def tokenized_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in its partition; stored in the shared folder."""
    path = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in common.pieces(batches, most_bytes=PIECE_BYTES):
            ids, counts = encoder(path).encode(batch.column("text"))
            counts = counts + 1
            first = np.cumsum(counts) - counts
            with_end = np.full(int(counts.sum()), end_id, "<u4")
            with_end[common.ragged(first, counts - 1)] = ids
            n_pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n_pieces)
            number = common.ragged(np.zeros(len(counts), np.int64), n_pieces)
            start = number * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (first[row] + start).tolist()
            order = np.argsort(length, kind="stable")
            in_order = length[order]
            _, begin, many = np.unique(in_order, return_index=True, return_counts=True)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(begin, many) + seen[in_order]
            np.add.at(seen, length, 1)
            chunks = [with_end[a : a + n].tobytes() for a, n in zip(at, length.tolist())]
            columns = {
                "part": pa.array(np.full(len(row), part, np.int32)), "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(number.astype(np.int32)), "start": pa.array(start),
                "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(x) for x in chunks], pa.int64()), "rank_in_part": pa.array(rank),
            }
            if with_ids:
                columns["ids"] = pa.array(chunks, pa.binary())
            yield pa.record_batch(columns)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.stored(rows.mapInArrow(cut, PIECES_SCHEMA + ", ids binary" * with_ids), "pieces")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    # The slots of a length, in order of rank: a piece finds its own by binary search. Bulk packing splits a group of like
    # sequences in three at most per length, so there are some thousands of slots, whatever the size of the corpus.
    table: dict[int, list] = {}
    for length, *slot in slots(pack_histogram(histogram, capacity)):
        table.setdefault(length, []).append(slot)
    lookup = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in table.items()})
    # Ranks of a length run through the partitions in their order. There are at most partitions x capacity such counts.
    before = by_part.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank_in_part") + F.col("before"))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for value, rows in pd.Series(np.arange(len(length))).groupby(length.to_numpy()):
            at = rows.to_numpy()
            first, _, seq, off = lookup.value[value]
            i = np.searchsorted(first, rank.to_numpy()[at], "right") - 1
            sequence[at], offset[at] = seq[i] + rank.to_numpy()[at] - first[i], off[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("p", place("length", "rank"))
    return placed.select("*", "p.sequence_id", "p.offset").drop("p", "part", "rank_in_part", "before", "rank")


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian unsigned 32-bit) for each piece."""
    return assign(tokenized_pieces(documents, capacity, vocabulary, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pack(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids)).alias("ids"))


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
