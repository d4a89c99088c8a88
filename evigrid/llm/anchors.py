"""Content-chosen anchors: what makes the search for repeated windows exact without looking at all pairs of windows.

The anchor of a window is its k-gram with the smallest hash, the leftmost of equals. Equal windows have their anchors at the
same offset, so that a window can only repeat within the group of its anchor's k-gram; and one anchor serves the many
consecutive windows that chose it. A filter of fixed size tells which k-grams can occur twice: one bit for each of
FILTER_BITS slots. However much falls into a slot, it lets no repeated k-gram go; the more, the more others pass it too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, mix, stored

FILTER_BITS = 1 << 27


@dataclass
class Anchors:
    """Each anchor of a block: its k-gram's hash, its place, and the first and last window start it serves."""

    key: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, where: np.ndarray) -> "Anchors":
        return Anchors(self.key[where], self.at[where], self.low[where], self.high[where])

    def joined(self, more: "Anchors") -> "Anchors":
        pairs = zip((self.key, self.at, self.low, self.high), (more.key, more.at, more.low, more.high))
        return Anchors(*[np.concatenate(p) for p in pairs])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i, from running minima within blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    """Anchors of all windows of a sequence that lie within one of the texts that `offsets` bounds."""
    n = len(values)
    if n < window:
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none, none, none)
    at = np.arange(n - gram + 1)
    key = SpanHasher(values).every(gram)
    least = sliding_min((key & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), window - gram + 1)
    # Window starts that leave room in their text.
    steps = np.zeros(n + 1, np.int64)
    room = np.maximum(np.diff(offsets) - window + 1, 0)
    np.add.at(steps, offsets[:-1][room > 0], 1)
    np.add.at(steps, (offsets[:-1] + room)[room > 0], -1)
    start = np.flatnonzero(np.cumsum(steps[: n - window + 1]) > 0)
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    ends = np.concatenate((begins[1:], [len(place)]))[: len(begins)] - 1
    return Anchors(key[place[begins]], place[begins], start[begins], start[ends])


def slots(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % np.uint64(FILTER_BITS)).astype(np.int64)


def bitmap(rows: DataFrame) -> np.ndarray:
    """A filter from rows of `slot`: 64-bit words, or the sorted slots while these take less room.

    Tasks send them as packed arrays; the driver gets FILTER_BITS / 64 words at most.
    """
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    words = rows.groupBy(F.expr("cast(shiftright(slot, 6) AS int)").alias("word")).agg(F.bit_or(bit).alias("bits"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = (batch.column(c).to_numpy() for c in ("word", "bits"))
            yield pa.record_batch({"word": pa.array([word.tobytes()], pa.binary()), "bits": pa.array([bits.tobytes()], pa.binary())})

    found = words.mapInArrow(packed, "word binary, bits binary").collect()
    word = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(r["word"], np.int32) for r in found]])
    bits = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["bits"], np.uint64) for r in found]])
    if len(word) * 64 < FILTER_BITS // 64:
        every = (word.astype(np.int64)[:, None] << 6) + np.arange(64)
        return np.sort(every[(bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) > 0])
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[word] = bits
    return out


def repeated_filter(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], large: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters of the slots that two anchors or more fell into, and of those that more than `large` fell into."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in keys_of(batch):
                slot, n = np.unique(slots(keys), return_counts=True)
                yield pa.record_batch({"slot": pa.array(slot), "n": pa.array(n.astype(np.int64))})

    sums = stored(rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1"), "slots")
    return bitmap(sums), bitmap(sums.where(F.col("n") > large))


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = slots(keys)
    if bits.dtype == np.int64:
        at = np.searchsorted(bits, slot)
        found = at < len(bits)
        found[found] = bits[at[found]] == slot[found]
        return found
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


# ---------------------------------------------------------------- documents and their spans


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: rows with equal doc_id and text have the same spans, and so need no other identity."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds `spans`, the sorted spans (s, e, and more columns if any) of each document, to ``identified`` rows; an empty list where there are none."""
    span = F.struct(*[c for c in spans.columns if c not in ("doc_id", "text_hash")])
    lists = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans")).withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "t")
    joined = rows.join(lists, rows.doc_id.eqNullSafe(lists.d) & (rows.text_hash == lists.t), "left")
    return joined.select("doc_id", "text", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans"))
