"""Suffix-array dedup: a distributed merge sort of sampled suffixes that never compares a known common prefix again.

A byte is removed where a LENGTH-byte string that covers it also starts somewhere else. Strings that can be equal share an
anchor (see ``anchors``), so only the suffixes that begin at anchors are sorted. Tasks sort the suffixes of their block,
fold those with equal surroundings into one, and send the sorted runs front-coded: of each suffix, the length of the prefix
it shares with the one before and the bytes after that, next to the bytes on its left, all compressed. Runs are split by the hash of the
anchor, so that each part has whole groups. A part merges its runs with a loser tree: entries know their common prefix with the
last winner, which decides most comparisons; others begin after the known prefix. The merged order and its common prefixes
(the part of the suffix array at the anchors) give, for each offset, the suffixes equal on the right; those also equal
on the left stand for repeated strings.

Passages of 50 words are mostly shorter than 400 bytes. They are found in the same way, over words in place of bytes: suffixes
are words that each end with a space, and common prefixes count whole words. They are told, not removed.

Edge cases: a null or empty text loses nothing; a repeated row is another place where its strings start; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .anchors import Anchors, anchors, identified, passes, repeated_filter, with_spans
from .automata import _NULL, by_part
from .common import SPACED, TextBlock

LENGTH = 400
GRAM = 48
#: Words (maximal runs of other than blanks) of a passage that is told where it starts elsewhere too.
WORDS = 50
WORD_GRAM = 8
PARTS = 4  # for each shuffle partition
BLOCK_BYTES = 1 << 20

RUNS_SCHEMA = "part int, shared binary, rights binary, lefts binary, packed binary, members binary, doc_id binary, text_hash binary, at binary"
SPANS_SCHEMA = "doc_id long, text_hash long, s long, e long"


# ---------------------------------------------------------------- sorted runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes need no look."""
    most, step, low = min(len(a), len(b)), 16, known
    while low < most:
        high = min(low + step, most)
        if a[low:high] != b[low:high]:
            break
        low, step = high, 2 * step
    else:
        return most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_coded(run: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of each string of a sorted run: the prefix shared with the one before, and the rest."""
    shared = [0][: len(run)] + [common_prefix(a, b) for a, b in zip(run, run[1:])]
    return shared, [x[n:] for x, n in zip(run, shared)]


class Run:
    """A front-coded run, read from its first string on."""

    def __init__(self, shared: list[int], rests: list[bytes]):
        self.shared, self.rests, self.i = shared, rests, -1
        self.text: bytes | None = b""
        self.advance()

    def advance(self) -> int:
        """Goes to the next string; returns its common prefix with the one before."""
        self.i += 1
        if self.i == len(self.shared):
            self.text = None
            return 0
        n = self.shared[self.i]
        self.text = self.text[:n] + self.rests[self.i]
        return n


def merged(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, string, common prefix with the string before) in sorted order, by a loser tree.

    known[r] is the common prefix of the run's string with the last winner that beat it. Of two strings that both follow that
    winner, the one with the longer common prefix comes first; only equals are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    known = [0] * k
    texts = [r.text for r in runs] + [None] * (k - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its common prefix with the winner."""
        if texts[a] is None or texts[b] is None:
            return (a, b) if texts[b] is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(texts[a], texts[b], known[a])
        first = (a, b) if (texts[a][n : n + 1], a) <= (texts[b][n : n + 1], b) else (b, a)
        known[first[1]] = n
        return first

    losers = [0] * k
    winners = list(range(k))
    level = k
    while level > 1:
        ahead = []
        for i in range(0, level, 2):
            w, loser = play(winners[i], winners[i + 1])
            losers[(level + i) // 2] = loser
            ahead.append(w)
        winners, level = ahead, level // 2
    w = winners[0]
    while texts[w] is not None:
        yield w, runs[w].i, texts[w], known[w]
        known[w] = runs[w].advance()
        texts[w] = runs[w].text
        at = (w + k) // 2
        while at:
            w, losers[at] = play(w, losers[at])
            at //= 2


# ---------------------------------------------------------------- blocks to runs


@dataclass
class Units:
    """The texts of a block as units: a value of each to hash, the first one of each text, and where each starts in `raw`."""

    values: np.ndarray
    offsets: np.ndarray
    raw: bytes
    starts: np.ndarray
    before: int  # bytes by which what parts units precedes them


def byte_units(column: pa.Array) -> Units:
    block = TextBlock(column)
    return Units(block.bytes, block.offsets, block.bytes.tobytes(), np.arange(len(block.bytes) + 1), 0)


def word_units(column: pa.Array) -> Units:
    """Words between single spaces: those from a to b are raw[starts[a] : starts[b]], each with the space that ends it."""
    words = TextBlock(column).words(SPACED)
    sizes = words.ends - words.starts
    starts = np.cumsum(np.concatenate(([1], sizes + 1)))
    spaced = np.full(int(starts[-1]), 32, np.uint8)
    spaced[common.ragged(starts[:-1], sizes)] = words.block.bytes[common.ragged(words.starts, sizes)]
    return Units(words.hashes(), words.first, spaced.tobytes(), starts, 1)


def words_in(text: bytes) -> int:
    """The whole words of a prefix of words that each end with a space."""
    return text.count(b" ")


@dataclass(frozen=True)
class Method:
    """What is a unit, how many are in bytes that end with a whole one, and how long strings and the grams of anchors are."""

    units: Callable[[pa.Array], Units]
    count: Callable[[bytes], int]
    length: int
    gram: int


def over_bytes(length: int = LENGTH) -> Method:
    return Method(byte_units, len, length, GRAM)


def over_words(length: int = WORDS) -> Method:
    return Method(word_units, words_in, length, WORD_GRAM)


def _blocks(batch: pa.RecordBatch, method: Method) -> Iterator[tuple[pa.RecordBatch, Units, Anchors]]:
    for piece in common.pieces(iter([batch]), most_bytes=BLOCK_BYTES):
        units = method.units(piece.column("text"))
        yield piece, units, anchors(units.values, units.offsets, method.length, method.gram)


def _runs(piece: pa.RecordBatch, units: Units, found: Anchors, length: int, parts: int) -> Iterator[tuple]:
    """A row for each part: its front-coded run, with the members of each folded suffix."""
    doc = np.searchsorted(units.offsets, found.at, "right") - 1
    ids = piece.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)[doc]
    texts = piece.column("text_hash").to_numpy(zero_copy_only=False)[doc]
    place = found.at - units.offsets[doc]
    raw, back = units.raw, units.before
    low, at, end = (units.starts[x].tolist() for x in (found.low, found.at, found.high + length))
    # right: from the anchor to the end of the last window; left: from the start of the first window to the anchor.
    by_part: dict[int, dict[tuple[bytes, bytes, int], list]] = {}
    for i, (part, nearest) in enumerate(zip((found.key % np.uint64(parts)).tolist(), (found.at - found.high).tolist())):
        context = (raw[at[i] : end[i]], raw[low[i] - back : at[i] - back], nearest)
        by_part.setdefault(part, {}).setdefault(context, []).append((ids[i], texts[i], place[i]))
    for part, contexts in by_part.items():
        order = sorted(contexts)
        shared, rests = front_coded([c[0] for c in order])
        members = [contexts[c] for c in order]
        who = np.array([m for x in members for m in x], np.int64).reshape(-1, 3)
        yield (
            part, np.array(shared, "<u4").tobytes(), np.array([len(x) for x in rests], "<u4").tobytes(), np.array([(len(c[1]), c[2]) for c in order], "<u4").tobytes(),
            pa.compress(b"".join([*rests, *(c[1] for c in order)]), codec="zstd", asbytes=True),
            np.array([len(x) for x in members], "<u4").tobytes(), who[:, 0].tobytes(), who[:, 1].tobytes(), who[:, 2].tobytes(),
        )


def runs(rows: DataFrame, method: Method) -> DataFrame:
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(repeated_filter(rows, lambda batch: (a.key for *_, a in _blocks(batch, method)), 1)[0])
    parts = PARTS * common.partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUNS_SCHEMA.split(", ")]
        for batch in batches:
            for piece, units, found in _blocks(batch, method):
                made = list(_runs(piece, units, found.take(passes(bits.value, found.key)), method.length, parts))
                if made:
                    yield pa.record_batch([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*made))], names=names)

    return rows.mapInArrow(cut, RUNS_SCHEMA)


# ---------------------------------------------------------------- merged parts to spans


def _unpacked(packed: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    data = pa.decompress(packed, decompressed_size=ends[-1], codec="zstd", asbytes=True)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def repeats(prefix: np.ndarray, lefts: list[bytes], nearest: np.ndarray, weight: np.ndarray, length: int, count: Callable[[bytes], int] = len) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes: the largest and smallest offset of an anchor in a repeated string (-1 and `length` if none).

    prefix: common prefix with the suffix before, in units that `count` counts; nearest: the smallest offset that the suffix serves; weight: its members.
    The offsets of repeated strings need not be all between the two, but the strings cover all that lies between.
    """
    m = len(lefts)
    farthest = np.array([count(x) for x in lefts], np.int64)
    # The units on the left, from the anchor backwards, sorted: neighbours with a common prefix of n are equal for n units.
    backwards = [x[::-1] for x in lefts]
    sorted_ = sorted(range(m), key=backwards.__getitem__)
    shared = np.array([0][:m] + [count(backwards[j][: common_prefix(backwards[i], backwards[j])]) for i, j in zip(sorted_, sorted_[1:])], np.int64)
    place = np.empty(m, np.int64)
    place[sorted_] = np.arange(m)
    most, least = np.full(m, -1), np.full(m, length)
    for offset in range(int(farthest.max(initial=0)) + 1):
        here = np.flatnonzero((nearest <= offset) & (offset <= farthest))
        if len(here) == 0:
            continue
        # Strings are equal where the suffixes are in one group of the right side and in one of the left side.
        key = np.cumsum(prefix < length - offset)[here] * (m + 1) + np.cumsum(shared < offset)[place[here]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = weight[here] > 1
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        rows = here[twice]
        most[rows] = offset
        least[rows] = np.minimum(least[rows], offset)
    return most, least


def _judged(rows: list[dict], length: int, count: Callable[[bytes], int]) -> pa.RecordBatch:
    u4 = lambda c: [np.frombuffer(r[c], "<u4").astype(np.int64) for r in rows]
    left_sizes, nearest_of = zip(*[x.reshape(-1, 2).T for x in u4("lefts")])
    texts = [_unpacked(r["packed"], np.concatenate(sizes)) for r, *sizes in zip(rows, u4("rights"), left_sizes)]
    decoded = [Run(s.tolist(), x[: len(s)]) for s, x in zip(u4("shared"), texts)]
    members_of = u4("members")
    base = np.cumsum([0] + [len(x) for x in members_of])
    order, prefix = [], []
    for run, i, text, shared in merged(decoded):
        order.append(base[run] + i)
        prefix.append(count(text[:shared]))
    order, prefix = np.array(order, np.int64), np.array(prefix, np.int64)
    lefts = [x for part in texts for x in part[len(part) // 2 :]]
    nearest, weight = np.concatenate(nearest_of)[order], np.concatenate(members_of)
    most, least = repeats(prefix, [lefts[i] for i in order], nearest, weight[order], length, count)
    hit = most >= 0
    entry = order[hit]
    first = np.cumsum(weight) - weight
    who = common.ragged(first[entry], weight[entry])
    ids, hashes, at = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows])[who] for c in ("doc_id", "text_hash", "at"))
    far, near = np.repeat(most[hit], weight[entry]), np.repeat(least[hit], weight[entry])
    return pa.record_batch({"doc_id": pa.array(ids, mask=ids == _NULL), "text_hash": pa.array(hashes), "s": pa.array(at - far), "e": pa.array(at - near + length)})


def repeated_spans(rows: DataFrame, method: Method) -> DataFrame:
    """Spans (s, e) of units of ``identified`` documents that strings found elsewhere cover; they may overlap."""
    found = runs(rows, method).repartition(common.partitions(rows.sparkSession), "part").sortWithinPartitions("part")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_part(batches):
            yield _judged(part, method.length, method.count)

    return found.mapInArrow(judge, SPANS_SCHEMA)


KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_words_repeated long"


def union(spans: list[dict]) -> Iterator[tuple[int, int]]:
    """Spans sorted by their start as maximal ones that do not touch."""
    start = end = None
    for span in spans:
        if end is None or span["s"] > end:
            if end is not None:
                yield start, end
            start, end = span["s"], span["e"]
        end = max(end, span["e"])
    if end is not None:
        yield start, end


def dedup(documents: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) and n_words_repeated of each document row.

    n_words_repeated: the words covered by `words` consecutive ones that also start elsewhere, removed or not.
    """
    rows = identified(documents)
    byte_spans = repeated_spans(rows, over_bytes(length)).withColumn("of_words", F.lit(False))
    word_spans = repeated_spans(rows, over_words(words)).withColumn("of_words", F.lit(True))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            block = TextBlock(batch.column("text"))
            raw = block.bytes.tobytes()
            columns: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "n_words_repeated": []}
            for begin, end, spans in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), batch.column("spans").to_pylist()):
                text = raw[begin:end]
                out, last, n = [], 0, 0
                for s, e in union([x for x in spans if not x["of_words"]]):
                    out.append(text[last:s])
                    last, n = e, n + 1
                out.append(text[last:])
                kept = b"".join(out)
                repeated = sum(e - s for s, e in union([x for x in spans if x["of_words"]]))
                for name, value in zip(columns, (len(text), len(text) - len(kept), n, kept, repeated)):
                    columns[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(v, kind) for v, kind in zip(columns.values(), kinds)]], names=["doc_id", *columns])

    return with_spans(rows, byte_spans.unionByName(word_spans)).mapInArrow(remove, KEPT_SCHEMA)


def op6(spark, sf_dir: str) -> DataFrame:
    found = dedup(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"), "n_words_repeated")
