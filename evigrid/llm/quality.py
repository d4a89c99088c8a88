"""Quality rules: fixed word rules, then a log-likelihood ratio of hashed n-grams with one threshold for all documents.

Words and word pairs of every document are hashed to BUCKETS counts; half of the trusted documents (labels.quality = 1,
and no label toxic) give the target multinomial, all documents the raw one. A document's score is the mean of log(target / raw) over its
n-grams. The threshold is a low quantile of the scores of the other, held-out half of the trusted documents, less a
margin: the same number for every document, so that reruns decide alike.

Every trusted document counts, on one side or the other; their ids meet the documents and the scores in joins, of which
Spark broadcasts small ones, so that no list of ids goes through the driver.

Edge cases: a null or empty text has no words, fails the base rules and is rejected; repeated rows are judged alike;
without trusted labels no document is rejected by its score; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quantiles
from . import common
from .common import SPACED, SpanHasher, TextBlock, mix

BUCKETS = 10_000
QUANTILE = 0.002
MARGIN = 0.02
REPEAT_WINDOW = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _grams(h: np.ndarray, doc: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and documents of all words and of all word pairs within a document."""
    pairs = np.flatnonzero(doc[:-1] == doc[1:]) if n > 1 else np.zeros(0, int)
    grams = np.concatenate((h, mix(h[pairs] * np.uint64(3) + h[pairs + 1]) if len(pairs) else h[:0]))
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate((doc, doc[pairs]))


def trusted(labels: DataFrame) -> DataFrame:
    """trusted_id, fit: every trusted document, once; the target is fitted on those with `fit`, the others are held out for the threshold."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("trusted_id"))
    rows = told.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") != 0).alias("toxic")).where("good > 0 AND toxic = 0")
    return rows.select("trusted_id", (F.pmod(F.xxhash64("trusted_id"), F.lit(2)) == 0).alias("fit"))


def trusted_ids(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of all trusted documents, those fitted on and those held out, for a look at a small table: no query collects them."""
    ids = trusted(labels).toPandas()
    return np.sort(ids.trusted_id[ids.fit].to_numpy(np.int64)), np.sort(ids.trusted_id[~ids.fit.astype(bool)].to_numpy(np.int64))


def log_ratios(documents: DataFrame, chosen: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket, from counts over all documents; chosen: the rows of ``trusted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in common.pieces(batches):
            words = TextBlock(batch.column("text")).words(SPACED)
            bucket, doc = _grams(words.hashes(), words.doc, len(words.starts), buckets)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[batch.column("fit").to_numpy(zero_copy_only=False)[doc]], minlength=buckets)
        yield pa.record_batch({"bucket": pa.array(np.arange(buckets)), "raw": pa.array(raw), "target": pa.array(target)})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fit = chosen.where("fit").select("trusted_id", "fit")
    rows = rows.join(fit, F.col("doc_id") == F.col("trusted_id"), "left").select("doc_id", "text", F.coalesce("fit", F.lit(False)).alias("fit"))
    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums.bucket], target[sums.bucket] = sums.raw, sums.target
    if not target.sum():
        return np.zeros(buckets)
    # The target is smoothed with the raw counts, in the proportion of one part in ten.
    p = (raw + 1) / (raw + 1).sum()
    q = 0.9 * target / target.sum() + 0.1 * p
    return np.log(q / p)


def _repeated(words: common.Words, h: np.ndarray, size: int) -> np.ndarray:
    """For each text: words in windows that occur twice or more in the text. Windows with one hash are compared word by word."""
    at = words.windows(size)
    if not len(at):
        return np.zeros(words.block.n, np.int64)
    key = SpanHasher(h)(at, at + size) ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    differ = np.zeros(len(a), bool)
    for k in range(size):
        differ |= common.unlike(words.block.bytes, words.starts[a + k], words.ends[a + k], words.starts[b + k], words.ends[b + k])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = common.covered(at[twice], at[twice] + size, len(h))
    out = np.bincount(words.doc[inside], minlength=words.block.n)
    for text in set(words.doc[a[differ]].tolist()) | set(words.doc[b[differ]].tolist()):  # windows with one hash that differ
        first, n = int(words.first[text]), int(words.counts[text])
        mine = [words.block.bytes[words.starts[i] : words.ends[i]].tobytes() for i in range(first, first + n)]
        seen = Counter(tuple(mine[i : i + size]) for i in range(n - size + 1))
        out[text] = len({j for i in range(n - size + 1) if seen[tuple(mine[i : i + size])] > 1 for j in range(i, i + size)})
    return out


def _dup_lines(block: TextBlock, words: common.Words) -> np.ndarray:
    """For each text: lines with a word that equal an earlier line. Lines with one hash are compared byte by byte."""
    breaks = np.flatnonzero(block.bytes == 10)
    starts = np.unique(np.concatenate((breaks + 1, block.offsets[:-1])))
    starts = starts[starts < len(block.bytes)]
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(block.bytes)), block.offsets[doc + 1])
    ends = np.where((ends > starts) & (block.bytes[np.maximum(ends - 1, 0)] == 10), ends - 1, ends)
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    key = SpanHasher(block.bytes)(starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    out = np.bincount(doc[b], minlength=block.n)
    differ = common.unlike(block.bytes, starts[a], ends[a], starts[b], ends[b])
    for text in set(doc[a[differ]].tolist()) | set(doc[b[differ]].tolist()):  # lines with one hash that differ
        mine = np.flatnonzero(doc == text)
        out[text] = len(mine) - len({block.bytes[starts[i] : ends[i]].tobytes() for i in mine.tolist()})
    return out


SCORES_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double"


def _judge(batch: pa.RecordBatch, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """The base numbers and the score of each text of a batch."""
    block = TextBlock(batch.column("text"))
    words = block.words(SPACED)
    h = words.hashes()
    bucket, doc = _grams(h, words.doc, len(h), len(ratios))
    total = np.bincount(doc, ratios[bucket], minlength=block.n)
    n = words.counts
    repeated = _repeated(words, h, REPEAT_WINDOW)
    points = (block.bytes & 0xC0) != 0x80
    return {
        "n_words": n.astype(np.int64), "word_chars": block.per_doc(points & words.inside), "n_symbols": block.per_doc(_SYMBOLS[block.bytes]),
        "n_dup_lines": _dup_lines(block, words), "n_repeat_words": repeated, "base_failed": (n < 20) | (100 * repeated > 30 * n),
        "score": total / np.maximum(np.bincount(doc, minlength=block.n), 1),
    }


def scores(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The base numbers and the score of each document row."""
    sent = documents.sparkSession.sparkContext.broadcast(ratios)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in _judge(batch, sent.value).items()})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, SCORES_SCHEMA)


def threshold(scored: DataFrame, chosen: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> float:
    """The quantile of the held-out trusted scores of documents that the base rules keep, less the margin; exact, and no task holds all scores."""
    held = chosen.where("NOT fit").select("trusted_id")
    kept = scored.where("NOT base_failed").join(held, F.col("doc_id") == F.col("trusted_id"), "left_semi").select(F.lit(0).alias("g"), "score")
    found = quantiles.quantiles(kept, "g", "score", {"least": quantile}).first()
    return float("-inf") if found is None or found["least"] is None else found["least"] - margin


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``scores``, and kept."""
    chosen = common.stored(trusted(labels), "trusted")
    scored = common.stored(scores(documents, log_ratios(documents, chosen)), "scores")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold(scored, chosen)))


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns; texts are judged again rather than stored or shuffled."""
    chosen = common.stored(trusted(labels), "trusted")
    ratios = log_ratios(documents, chosen)
    least = threshold(common.stored(scores(documents, ratios).select("doc_id", "score", "base_failed"), "scores"), chosen)
    sent = documents.sparkSession.sparkContext.broadcast(ratios)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            judged = _judge(batch, sent.value)
            yield batch.filter(pa.array(~judged["base_failed"] & (judged["score"] >= least)))

    return documents.mapInArrow(keep, documents.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    judged = quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
