"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into segments of bounded size and stores for each one its vocabulary and the postings of all of its
words (the sorted positions of each). ``search`` cuts the benchmark, a stated query set, into windows, each kept once with its items.
A first look at the vocabularies alone gives the document-wide frequency of the benchmark's words, and so the rarest word of each
window; windows with a word that occurs nowhere are done. A second look tells which segments have that word: a window meets only
these. There its candidate places start from the postings of the word that is rarest in the segment and are intersected with the
offset-adjusted postings of the others, rarer ones first; each segment's postings are decoded once. With ``slack`` 0 the places are
exact phrase matches. A proximity match is a place p of a document such that, for each i, the window's i-th word occurs in that
document within ``slack`` words of place p + i.

Words are joined as strings. Within a segment they are looked up by 62-bit hashes and compared by their bytes, also when the index is
built: words with one hash have postings of their own.

Edge cases: null and empty texts have no words and no hits; repeated document rows are judged one by one; items without
words or without an id match nothing; an empty benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .anchors import identified
from .common import ALNUM, TextBlock

WINDOW = 13
#: Bytes of text in a segment, and of windows that a task looks up at once.
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
#: Bytes of a row group of the stored index: a few segments, however many a task writes or reads.
GROUP_BYTES = 16 << 20
#: Candidate places that a task holds at once.
CANDIDATES = 1 << 20

INDEX_SCHEMA = "segment long, doc_ids array<long>, text_hashes array<long>, n_words array<int>, words array<string>, counts array<int>, terms binary, gaps binary"
#: How far a word may stand off its place in the proximity matches that ``decontaminate`` reports.
NEAR = 2
MATCH_SCHEMA = "segment long, place int, doc_id long, text_hash long, n_words int, items array<string>, spans array<struct<s:int,e:int>>, near_items array<string>"


# ---------------------------------------------------------------- index


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte planes: small gaps leave planes of zeros, which Parquet's codec removes."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _word_order(words: common.Words, h: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block sorted by hash, equal ones by place, and where each different word begins among them."""
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = h[a] == h[b]
    new = np.ones(len(order), bool)
    new[1:] = ~same
    differ = common.unlike(data, words.starts[a[same]], words.ends[a[same]], words.starts[b[same]], words.ends[b[same]])
    if differ.any():  # words with one hash: each of them gets a run of its own
        rank = np.zeros(len(h), np.int64)
        for value in np.unique(h[b[same][differ]]):
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(h == value).tolist():
                rank[i] = seen.setdefault(data[words.starts[i] : words.ends[i]].tobytes(), len(seen))
        order = np.lexsort((rank, h))
        new[1:] = (h[order][1:] != h[order][:-1]) | (rank[order][1:] != rank[order][:-1])
    return order, np.flatnonzero(new)


def _segment(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    block = TextBlock(batch.column("text"))
    words, data = block.words(ALNUM), block.lowered()
    # One unused position after each document keeps phrases from crossing documents.
    position = np.arange(len(words.starts)) + words.doc
    h = words.hashes(lower=True)
    order, begin = _word_order(words, h, data)
    gaps = np.diff(position[order], prepend=0)
    gaps[begin] = position[order][begin]
    one = order[begin]
    lengths = words.ends[one] - words.starts[one]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    vocabulary = pa.StringArray.from_buffers(len(one), pa.py_buffer(offsets), pa.py_buffer(data[common.ragged(words.starts[one], lengths)].tobytes()))
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = {
        "segment": pa.array([number], pa.int64()), "doc_ids": listed(batch.column("doc_id")), "text_hashes": listed(batch.column("text_hash")), "n_words": listed(pa.array(words.counts.astype(np.int32))),
        "words": listed(vocabulary), "counts": listed(pa.array(np.diff(np.append(begin, len(order))).astype(np.int32))), "terms": pa.array([h[one].tobytes()], pa.binary()), "gaps": pa.array([_planes(gaps)], pa.binary()),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def build_index(documents: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Stores the positional index of doc_id, text in the shared folder; a row for each segment."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(common.pieces(batches, most_bytes=segment_bytes)):
            yield _segment(batch, first + i)

    return common.stored(identified(documents).mapInArrow(index, INDEX_SCHEMA), "postings", GROUP_BYTES)


# ---------------------------------------------------------------- windows and the segments they meet


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """phrase (lower-cased words, with one space between them) and items (sorted) of each different window; stored."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            block = TextBlock(piece.column("text"))
            words, raw = block.words(ALNUM), block.lowered().tobytes()
            told = [raw[s:e].decode("utf-8") for s, e in zip(words.starts.tolist(), words.ends.tolist())]
            for name, first, n in zip(piece.column("item_id").to_pylist(), words.first.tolist(), words.counts.tolist()):
                phrases = sorted({" ".join(told[i : min(i + size, first + n)]) for i in range(first, first + max(1, n - size + 1))}) if n else []
                yield pa.record_batch([pa.array([name] * len(phrases), pa.string()), pa.array(phrases, pa.string())], names=["item_id", "phrase"])

    return common.stored(items.mapInArrow(cut, "item_id string, phrase string").groupBy("phrase").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")


def meetings(index: DataFrame, windows: DataFrame) -> DataFrame:
    """segment, phrase, items: the segments that have the rarest word of each window, in all segments together; stored."""
    words = windows.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    counted = index.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = common.stored(counted.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    rarest = words.join(known, "word", "left").groupBy("phrase").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    chosen = common.stored(rarest.select("phrase", "word").join(windows, "phrase"), "rarest")
    return common.stored(index.select("segment", F.explode("words").alias("word")).join(chosen, "word").select("segment", "phrase", "items"), "meetings")


# ---------------------------------------------------------------- search


class _Windows:
    """Different windows: word numbers by place (-1 past the end), and the items that have each."""

    def __init__(self, phrases: list[str], items: list[list[str]]):
        split = [p.split(" ") for p in phrases]
        self.vocabulary = sorted({w for words in split for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.lengths = np.array([len(words) for words in split], np.int64)
        self.terms = np.full((len(split), max(self.lengths, default=1)), -1, np.int32)
        for row, words in zip(self.terms, split):
            row[: len(words)] = [number[w] for w in words]
        self.items = items

    def owned(self, window: np.ndarray, doc: np.ndarray, into: list[set]) -> None:
        """Adds to each document's set the items of the windows found in it."""
        pairs = np.unique(np.stack((doc, window), 1), axis=0)
        for d, w in pairs.tolist():
            into[d].update(self.items[w])


class _Segment:
    """The postings of a segment, decoded; those that a vocabulary has as sorted (word number, position); the documents' bounds."""

    def __init__(self, row: dict):
        self.n_words = np.array(row["n_words"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.n_words + 1)))
        self.hashes, self.words = np.frombuffer(row["terms"], np.uint64), row["words"]
        self.counts = np.array(row["counts"], np.int64)
        steps = np.cumsum(_unplanes(row["gaps"]).astype(np.int64))
        self.begin = np.cumsum(self.counts) - self.counts
        # Gaps restart at each word: what had been summed before it is taken off.
        before = np.where(self.begin > 0, steps[self.begin - 1], 0) if len(self.begin) else self.begin
        self.positions = steps - np.repeat(before, self.counts)

    def look_up(self, vocabulary: list[str]) -> None:
        """Chooses the postings of some words."""
        asked = TextBlock(pa.array([" ".join(vocabulary)], pa.string())).words(ALNUM).hashes(lower=True)
        at = np.full(len(vocabulary), -1, np.int64)
        for i, (word, place, h) in enumerate(zip(vocabulary, np.searchsorted(self.hashes, asked).tolist(), asked)):
            while place < len(self.hashes) and self.hashes[place] == h:
                if self.words[place] == word:
                    at[i] = place
                    break
                place += 1
        here = at >= 0
        some = at[here]
        self.df = np.zeros(len(vocabulary), np.int64)
        self.df[here] = self.counts[some]
        self.keys = (np.repeat(np.flatnonzero(here), self.counts[some]) << 32) | self.positions[common.ragged(self.begin[some], self.counts[some])]
        self.first = np.concatenate(([0], np.cumsum(self.df)))

    def places(self, windows: _Windows, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, document, place in it) of all matches."""
        found = [(np.zeros(0, np.int64),) * 3]
        rarity = np.where(windows.terms >= 0, self.df[windows.terms], np.iinfo(np.int64).max) if len(self.df) else np.zeros((0, 1), np.int64)
        alive = np.flatnonzero(rarity.min(1) > 0)
        order = np.argsort(rarity[alive], axis=1, kind="stable")
        ahead = np.cumsum(rarity[alive, order[:, 0]]) * (2 * slack + 1) // CANDIDATES
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(ahead)) + 1) if len(alive) else ():
            offset = order[part, 0]
            term = windows.terms[alive[part], offset]
            which = np.repeat(part, self.df[term])
            position = self.keys[common.ragged(self.first[term], self.df[term])] & 0xFFFFFFFF
            doc = np.searchsorted(self.starts, position, "right") - 1
            shifts = np.arange(-slack, slack + 1)
            start = (position - np.repeat(offset, self.df[term]))[:, None] + shifts
            which, doc, start = np.repeat(which, len(shifts)), np.repeat(doc, len(shifts)), start.ravel()
            for rank in range(windows.terms.shape[1]):
                offset = order[which, rank]
                term = windows.terms[alive[which], offset].astype(np.int64)
                place, begin = start + offset, self.starts[doc]
                low, high = np.maximum(place - slack, begin), np.minimum(place + slack, begin + self.n_words[doc] - 1)
                at = np.searchsorted(self.keys, (term << 32) | np.maximum(low, 0))
                ok = (at < len(self.keys)) & (low <= high)
                ok[ok] = self.keys[at[ok]] <= ((term[ok] << 32) | high[ok])
                ok |= term < 0
                which, doc, start = which[ok], doc[ok], start[ok]
            found.append((alive[which], doc, start - self.starts[doc]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _matches(row: dict, asked: Iterator[_Windows], slacks: tuple[int, ...]) -> pa.RecordBatch:
    """The documents of a segment: the items and the spans of matches with the first slack, and the items with the last one."""
    n = len(row["n_words"])
    items, near = [[set() for _ in range(n)] for _ in range(2)]
    spans: list[list] = [[] for _ in range(n)]
    segment = None
    for windows in asked:
        segment = segment or _Segment(row)
        segment.look_up(windows.vocabulary)
        window, doc, start = segment.places(windows, slacks[0])
        windows.owned(window, doc, items)
        if len(slacks) > 1:
            windows.owned(*segment.places(windows, slacks[-1])[:2], near)
        ends = np.minimum(start + windows.lengths[window], segment.n_words[doc])
        for d, s, e in zip(doc.tolist(), np.maximum(start, 0).tolist(), ends.tolist()):
            spans[d].append((s, e))
    span, names = pa.struct({"s": pa.int32(), "e": pa.int32()}), pa.list_(pa.string())
    columns = {
        "segment": ([row["segment"]] * n, pa.int64()), "place": (range(n), pa.int32()), "doc_id": (row["doc_ids"], pa.int64()), "text_hash": (row["text_hashes"], pa.int64()), "n_words": (row["n_words"], pa.int32()),
        "items": ([sorted(x) for x in items], names), "spans": ([[{"s": s, "e": e} for s, e in _merged(x)] for x in spans], pa.list_(span)), "near_items": ([sorted(x) for x in (near if len(slacks) > 1 else items)], names),
    }
    return pa.record_batch([pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if done and s <= done[-1][1]:
            done[-1] = (done[-1][0], max(e, done[-1][1]))
        else:
            done.append((s, e))
    return done


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, near: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document row of the index: the items with matching windows and the word spans they hit; and the items
    that match with the slack ``near`` (if none is given, the same items).

    A segment and the windows that meet it come together in one task, which looks up about ``block_bytes`` of windows at a time.
    Of segments without a meeting only the documents are read.
    """
    slacks = (slack,) if near is None else (slack, near)
    met = meetings(index, windows_of(benchmark, window))
    busy = common.stored(met.select("segment").distinct(), "busy")

    def asked(phrases: pa.Table) -> Iterator[_Windows]:
        size = np.cumsum([len(p) for p in phrases.column("phrase").to_pylist()]) // block_bytes
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = phrases.slice(a, b - a)
            if part.num_rows:
                yield _Windows(part.column("phrase").to_pylist(), part.column("items").to_pylist())

    def match(segment: pa.Table, phrases: pa.Table) -> pa.Table:
        (row,) = segment.to_pylist()
        return pa.Table.from_batches([_matches(row, asked(phrases), slacks)])

    found = index.join(busy, "segment", "left_semi").groupBy("segment").cogroup(met.groupBy("segment")).applyInArrow(match, MATCH_SCHEMA)
    idle = index.join(busy, "segment", "left_anti").select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("place", "d"))
    none = idle.select(
        "segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_hashes").alias("text_hash"), F.col("d.n_words").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"), F.array().cast("array<string>").alias("near_items"),
    )
    return found.unionByName(none).withColumn("n_words", F.col("n_words").cast("long"))


def covered_words(spans: Column) -> Column:
    """The number of words in the union of spans."""
    return F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.e))).alias("n"), F.greatest(a.e, x.e).alias("e")),
        lambda a: a.n,
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items, spans, contaminated (5 % of its words or more are hit), and near_items (those
    with proximity matches, exact ones included) for each document row."""
    found = search(build_index(documents), benchmark, window, near=NEAR)
    hit = found.withColumn("n_hit", covered_words(F.col("spans")))
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    id_, hash_ = common.fresh(documents, "dirty_id"), common.fresh(documents, "dirty_hash")
    dirty = decontaminate(documents, benchmark, window).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(hash_))
    return documents.join(common.stored(dirty, "contaminated"), key, "left_anti")


def op2(spark, sf_dir: str) -> DataFrame:
    judged = decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"), F.array_join("near_items", ",").alias("near_items"),
    )
