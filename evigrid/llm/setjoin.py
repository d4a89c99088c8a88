"""Exact joins of shingle sets of documents, from buckets of sets that may be alike.

Documents with the same set share an id, and only sets are joined. A method of its own (chosen paths, banded sketches) puts the
sets into buckets; from there on:

1. Buckets are brute-forced on sketches, without pairs: a breadth-first search takes from the sets not yet reached those that look
   alike and yields a tree. A bucket with more sets than a task should hold is dealt in pairs of blocks.
2. Connected trees are candidate groups. Each is verified on the full sets, all of its sets against all others, in blocks bounded
   by sets and by shingles: a large group is dealt over many tasks. The result of a block pair is the number of links of each set
   and a tree of true links. Connected again, these are the classes.

No step emits the pairs of a group, and groups of equal texts count by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .anchors import identified
from .common import SpanHasher, TextBlock, mix

#: Sets, and shingles, of a block in a task; a task holds two blocks.
BLOCK = 500
BLOCK_SHINGLES = 1 << 20

ID = np.dtype([("a", "<u8"), ("b", "<u8")])
TREE_SCHEMA = "u binary, v binary"


# ---------------------------------------------------------------- sets of shingles


@dataclass(frozen=True)
class Shingles:
    """What a set is made of: runs of `size` lower-cased words, and the bytes that words consist of (as a table of 256)."""

    size: int
    word_bytes: bytes

    def sets(self, column: pa.Array) -> "Sets":
        return Sets(column, self.size, np.frombuffer(self.word_bytes, bool))

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, "Sets"]]:
        for batch in batches:
            for piece in common.pieces(iter([batch]), most_bytes=2 << 20):
                yield piece, self.sets(piece.column("text"))


class Sets:
    """The distinct shingles of each text of a block, text by text."""

    def __init__(self, column: pa.Array, size: int, table: np.ndarray):
        words = TextBlock(column).words(table)
        h = words.hashes(lower=True)
        first = words.first[:-1]
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        at = words.windows(size)
        hasher = SpanHasher(h)
        shingles = np.concatenate((hasher(at, at + size), hasher(first[short], first[short] + words.counts[short])))
        doc = np.concatenate((words.doc[at] if len(at) else at, short))
        order = np.lexsort((shingles, doc))
        shingles, doc = shingles[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
        self.shingles, self.doc = shingles[new], doc[new]
        self.n = np.bincount(self.doc, minlength=words.block.n)
        self.first = np.concatenate(([0], np.cumsum(self.n)))

    def ids(self) -> np.ndarray:
        """128 bits for each set: two sums of independent hashes of its shingles."""
        out = np.zeros(len(self.n), ID)
        for name, seed in (("a", 0x6A09E667F3BCC909), ("b", 0xBB67AE8584CAA73B)):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.shingles ^ np.uint64(seed)))))
            out[name] = mix((sums[self.first[1:]] - sums[self.first[:-1]]) + self.n.astype(np.uint64))
        return out


# ---------------------------------------------------------------- candidate trees


def spanning(n: int, alike) -> list[tuple[int, int]]:
    """Tree edges of the graph on range(n), by breadth-first search; alike(i, others) flags the others linked with i."""
    left, edges = np.arange(n), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = alike(i, left)
            new = left[hit].tolist()
            edges += [(i, j) for j in new]
            front += new
            left = left[~hit]
    return edges


def bucket_trees(key: np.ndarray, sid: np.ndarray, sketch: np.ndarray, alike: float, block: np.ndarray | None = None) -> pa.RecordBatch:
    """Tree edges of the sets that look alike in each bucket; where blocks are given, only between sets of two blocks."""
    order = np.lexsort((sid["b"], sid["a"], key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (sid[order][1:] != sid[order][:-1])
    order = order[new]
    key = key[order]
    # Equal bytes that two different coordinates have by chance are one in 256.
    need = sketch.shape[1] * (alike + (1 - alike) / 256)
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size, begin = np.diff(cuts), cuts[:-1]
    two = begin[size == 2]
    two = two[(sketch[order[two]] == sketch[order[two + 1]]).sum(1) >= need]
    edges = [np.stack((order[two], order[two + 1]), 1)]
    for a, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        at = order[a : a + n]
        mine, of = sketch[at], None if block is None else block[at]

        def met(i: int, others: np.ndarray, mine=mine, of=of) -> np.ndarray:
            if of is None:
                return (mine[others] == mine[i]).sum(1) >= need
            hit = of[others] != of[i]
            hit[hit] = (mine[others[hit]] == mine[i]).sum(1) >= need
            return hit

        found = spanning(n, met)
        if found:
            edges.append(at[np.array(found)])
    pairs = np.concatenate(edges)
    u, v = ([x.tobytes() for x in sid[pairs[:, i]]] for i in (0, 1))
    return pa.record_batch({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have `width` bytes, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def trees_in_blocks(rows: DataFrame, alike: float, width: int, bucket_most: int) -> DataFrame:
    """Tree edges of the buckets (key, n: the number of its sets, sid, sketch of `width` bytes).

    A bucket of more than `bucket_most` sets is cut into blocks of about that size, and each pair of blocks is a group of its own.
    """
    blocked = rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(bucket_most)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = paired.select("key", F.least("mine", "k").alias("i"), F.greatest("mine", "k").alias("j"), "mine", "sid", "sketch")
    dealt = dealt.repartition(common.partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(upto: pa.Table) -> Iterator[pa.RecordBatch]:
            i, j, key = (upto.column(c).to_numpy() for c in ("i", "j", "key"))
            sid, sketch, mine = _bytes(upto.column("sid"), 16).view(ID).ravel(), _bytes(upto.column("sketch"), width), upto.column("mine").to_numpy()
            across = i != j
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if len(key) else key
            for part, of in ((~across, None), (across, mine[across])):
                if part.any():
                    yield bucket_trees(group[part], sid[part], sketch[part], alike, of)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held)
            ends = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([e != e[-1] for e in ends]))
            full = int(last[-1]) + 1 if len(last) else 0
            if full:
                yield from done(table.slice(0, full))
            held = table.slice(full).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return dealt.mapInArrow(search, TREE_SCHEMA)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str) -> DataFrame:
    """u, root: the smallest node connected with each node of an edge, by alternating large and small stars.

    A node with very many neighbours is a hot key of the large stars. Its minimum is a grouped aggregate with partial sums; it is
    stored before the join, so that both sides of the join are plain shuffles and adaptive execution can split the hot one.
    """
    turned = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now, before = common.stored(edges.where("u <> v").select(*turned).distinct(), name), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            return now.withColumnRenamed("v", "root").unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        before = state
        # Large stars: neighbours that are larger go to the smallest neighbour. `now` has the larger node first.
        smaller = now.groupBy("u").agg(F.min("v").alias("m"))
        least = common.stored(now.select(F.col("v").alias("u")).distinct().join(smaller, "u"), f"{name}-least")
        moved = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u", "left")
        large = moved.select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        # Small stars: the node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = common.stored(small.distinct(), name)


# ---------------------------------------------------------------- verification


LINKS_SCHEMA = "sid binary, links long, other binary"


def _verified(group: list[dict], shingles: Shingles, similarity: float) -> list[tuple[bytes, int, bytes | None]]:
    """(set, links, null) for each set with links in this block pair, and (set, 0, other) for each edge of a tree of links."""
    sets = shingles.sets(pa.array([r["text"] for r in group], pa.string()))
    m = len(group)
    different, code = np.unique(sets.shingles, return_inverse=True)
    shared = np.bincount(code) > 1
    number = np.cumsum(shared) - 1
    common_ = shared[code]
    row, column = sets.doc[common_], number[code[common_]]
    both = np.zeros((m, m), np.float32)
    step = max(256, (8 << 20) // m)
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (low, low + step))
        part = np.zeros((m, min(step, int(shared.sum()) - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    n = sets.n.astype(np.float64)
    linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    # A pair of two sets of one block is judged where that block meets itself.
    block = np.array([r["mine"] for r in group])
    if group[0]["i"] != group[0]["j"]:
        linked &= block[:, None] != block[None, :]
    weight = np.array([r["weight"] for r in group], np.int64)
    links = linked @ weight
    out: list = [(group[i]["sid"], int(links[i]), None) for i in np.flatnonzero(links)]
    out += [(group[i]["sid"], 0, group[j]["sid"]) for i, j in spanning(m, lambda i, others: linked[i, others])]
    return out


def verify(rows: DataFrame, members: DataFrame, groups: DataFrame, shingles: Shingles, similarity: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links of the candidate groups (u: set, root: group), from the texts of one document of each set.

    A group is cut into blocks of about `block` sets, or of `block_shingles` shingles if its sets are large.
    """
    spark = rows.sparkSession
    one = members.groupBy("sid").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n").alias("n"))
    grouped = common.stored(groups.join(one, groups.u == one.sid).select("sid", "weight", "root", "n", F.col("one.doc_id").alias("d"), F.col("one.text_hash").alias("t")), "grouped")
    # Stored, so that adaptive execution can split the join with a large group.
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int")
    chosen = grouped.join(common.stored(grouped.groupBy("root").agg(blocks.alias("blocks")), "sizes"), "root").drop("n")
    texts = rows.join(chosen, rows.doc_id.eqNullSafe(chosen.d) & (rows.text_hash == chosen.t)).drop("d", "t").dropDuplicates(["sid"])
    mine = texts.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    pairs = mine.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = pairs.select("root", F.least("mine", "k").alias("i"), F.greatest("mine", "k").alias("j"), "mine", "sid", "weight", "text")
    dealt = dealt.repartition(common.partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            found = _verified(held, shingles, similarity)
            if found:
                sid, links, other = zip(*found)
                yield pa.record_batch({"sid": pa.array(sid, pa.binary()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][c] != row[c] for c in ("root", "i", "j")):
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    return dealt.mapInArrow(judge, LINKS_SCHEMA)


# ---------------------------------------------------------------- classes


def linked(rows: DataFrame, members: DataFrame, trees: DataFrame, shingles: Shingles, similarity: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_hash, n (shingles), class_id, n_links (other rows of the wanted similarity), copies_id (the smallest doc_id with the
    same set) and root (the class; null without words) of each row of `members` (doc_id, text_hash, sid: null without words, n).

    rows: ``identified`` documents; trees: edges u, v between the sets that may be linked."""
    found = components(trees, "groups")
    links = common.stored(verify(rows, members.where("sid IS NOT NULL"), found, shingles, similarity, block, block_shingles), "links")
    classes = components(links.where("other IS NOT NULL").select(F.col("sid").alias("u"), F.col("other").alias("v")), "classes")
    counted = links.where("other IS NULL").groupBy("sid").agg(F.sum("links").alias("links"))
    sets = members.where("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("weight"), F.min("doc_id").alias("copies_id"))
    named = common.stored(sets.join(classes.withColumnRenamed("u", "sid"), "sid", "left").join(counted, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "named")
    smallest = common.stored(named.groupBy("root").agg(F.min("copies_id").alias("class_id")), "smallest")
    named = named.join(smallest, "root").select("sid", "root", "class_id", "copies_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return members.join(named, "sid", "left").select(
        "doc_id", "text_hash", "n", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("copies_id")).alias("copies_id"), "root",
    )


def one_of_each(documents: DataFrame, judged: DataFrame) -> DataFrame:
    """The documents with one row of each class of `judged` (from ``linked``), that with the smallest doc_id; rows without words all stay."""
    classes = common.stored(judged, "classes")
    first = classes.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    stay = first.select("k.doc_id", "k.text_hash").unionByName(classes.where("root IS NULL").select("doc_id", "text_hash").distinct())
    stay_id, stay_hash, hash_, n = (common.fresh(documents, c) for c in ("stay_id", "stay_hash", "hash", "n"))
    stay = stay.select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash))
    hashed = documents.withColumn(hash_, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(stay_id)) & (F.col(hash_) == F.col(stay_hash))
    kept = hashed.join(stay, same, "left_semi")
    repeated = classes.where("root IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash))
    if repeated.isEmpty():
        return kept.drop(hash_)
    # Rows of one doc_id and text, both equal: the first of them stays.
    numbered = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", hash_).orderBy(hash_)))
    return numbered.join(repeated, same & (F.col(n) > 1), "left_anti").drop(hash_, n)
