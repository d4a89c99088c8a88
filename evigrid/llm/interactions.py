"""What five document filters remove alone, together and in each order: an audit of their interactions.

1. Scan. Batches of text are read as Arrow buffers: classes of bytes, and prefix sums of them over the texts' offsets, count words,
   capitals, symbols and code points; the word hashes of each text are sorted, and equal neighbours are compared byte by byte
   (a text whose hashes collide is counted anew by its words), which gives the distinct words. The filters A to D are bits of a mask.
2. Copies. Filter E needs the whole table: rows are grouped by text digest, part, mask and labels first, so that a text that a third
   of all rows hold is a few rows when the smallest doc_id of each text is found.
3. Masks reduce: at most 32 counts are left of each part, from which all orders and steps follow.

Edge cases: a null or empty text has no words, fails A, and equals other such texts; a row without doc_id has no labels, never fails E
and is no earlier copy; rows with the same doc_id and text count one by one and are no copies of each other; a null part is the
empty string; a document is good (toxic) if any row of its labels says so; an empty table has no parts and no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import SPACED, TextBlock, Words

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"

MARKS_SCHEMA = "doc_id long, part string, mask int, digest binary"


# ---------------------------------------------------------------- scan


def distinct_words(words: Words) -> np.ndarray:
    """The number of different words of each text: neighbours among its sorted hashes whose bytes are compared too."""
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    doc = words.doc[order]
    a, b = order[:-1], order[1:]
    same = (doc[1:] == doc[:-1]) & (h[a] == h[b])
    a, b = a[same], b[same]
    unlike = common.unlike(words.block.bytes, words.starts[a], words.ends[a], words.starts[b], words.ends[b])
    found = words.counts - np.bincount(words.doc[b], minlength=words.block.n)
    for text in set(words.doc[a[unlike]].tolist()):  # two words with one hash: by the words themselves
        mine = range(words.first[text], words.first[text + 1])
        found[text] = len({words.block.bytes[words.starts[i] : words.ends[i]].tobytes() for i in mine})
    return found


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_CAPITALS, _SYMBOLS, _FIRST = _class(bytes(range(65, 91))), _class(SYMBOLS), ~_class(bytes(range(0x80, 0xC0)))


def masks(block: TextBlock) -> np.ndarray:
    """Bits 0 to 3 of each text: whether it fails the filters A to D."""
    words = block.words(SPACED)
    n = words.counts
    fails = (
        n < LEAST_WORDS,
        100 * distinct_words(words) < DISTINCT_PERCENT * n,
        100 * block.per_doc(_CAPITALS[block.bytes]) > CAPITAL_PERCENT * block.per_doc(_FIRST[block.bytes]),
        block.per_doc(_SYMBOLS[block.bytes]) > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def marks(documents: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask of A to D and SHA-256 of the text, of each document row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            block = TextBlock(piece.column("text"))
            raw = memoryview(block.bytes)
            digests = [hashlib.sha256(raw[s:e]).digest() for s, e in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
            yield pa.record_batch([piece.column("doc_id"), piece.column("part"), pa.array(masks(block)), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return rows.mapInArrow(scan, MARKS_SCHEMA)


# ---------------------------------------------------------------- copies and labels


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The marks with `n`, the number of equal rows, and whether the labels call the document good and toxic."""
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = found.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    # Rows without doc_id match nothing; the second key deals them over all tasks.
    spread = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0)
    joined = rows.withColumn("spread", spread).join(judged.withColumn("zero", F.lit(0)), (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("zero")), "left")
    return joined.select("doc_id", "part", "mask", "digest", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def counts(rows: DataFrame) -> DataFrame:
    """part, mask (E is bit 4), n, good and toxic: the number of document rows with each mask."""
    key = ["digest", "part", "mask", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    copies = rows.groupBy(*key).agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    # What stays of a text: its rows with the smallest doc_id, and those without one.
    stay = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    kept = copies.withColumn("least", least).withColumn("stay", stay)
    both = F.explode(F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))))
    each = kept.select("part", "good", "toxic", both.alias("x"))
    n = F.col("x.n")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


# ---------------------------------------------------------------- orders

AUDIT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class _Steps:
    """All orders and steps, and for each step which of the 32 masks count for what."""

    def __init__(self):
        orders = np.array(list(permutations(range(len(FILTERS)))))
        bits = 1 << orders
        before = (np.cumsum(bits, axis=1) - bits).ravel()[:, None]
        bit = bits.ravel()[:, None]
        self.orders = ["".join(FILTERS[f] for f in order) for order in orders for _ in order]
        self.steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))
        mask = np.arange(1 << len(FILTERS))[None, :]
        fails, gone = (mask & bit) > 0, (mask & before) > 0
        self.kept, self.removed, self.redundant, self.alone = (x.astype(np.int64) for x in (~fails & ~gone, fails & ~gone, fails & gone, mask == bit))
        # A text that fails k filters is removed by each of them in one k-th of the orders.
        self.shapley = fails * (len(orders) // np.maximum(np.bitwise_count(mask), 1)).astype(np.int64)


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    per_mask = counts(labelled(marks(documents, part), labels))
    lists = [F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")]  # 32 at most
    per_part = per_mask.groupBy("part").agg(*lists)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _Steps()
        for batch in batches:
            for row in batch.to_pylist():
                n, good, toxic = np.zeros((3, 32), np.int64)
                for values, c in ((n, "n"), (good, "good"), (toxic, "toxic")):
                    values[row["mask"]] = row[c]
                found = every.kept @ n, every.removed @ n, every.redundant @ n, every.alone @ n, every.removed @ good, every.removed @ toxic, every.shapley @ n
                yield pa.record_batch([pa.array([row["part"]] * len(every.orders)), pa.array(every.orders), pa.array(every.steps), *map(pa.array, found)], names=[x.split()[0] for x in AUDIT_SCHEMA.split(", ")])

    return per_part.mapInArrow(walk, AUDIT_SCHEMA)


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Each filter tried on each document, and each order walked step by step; shapley by summing the orders.
OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
j AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT row_number() OVER () AS id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, unnest([
    {'f': 'A', 'fails': len(words) < 50},
    {'f': 'B', 'fails': 100 * len(list_distinct(words)) < 65 * len(words)},
    {'f': 'C', 'fails': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)},
    {'f': 'D', 'fails': regexp_matches(text, '[#$%&*|]')},
    {'f': 'E', 'fails': coalesce(doc_id > first, false)}]) AS x
  FROM (SELECT w.*, min(doc_id) OVER (PARTITION BY text) AS first FROM w) LEFT JOIN j USING (doc_id)),
m AS (SELECT id, part, good, toxic, string_agg(x.f, '') FILTER (WHERE x.fails) AS failed FROM f GROUP BY ALL),
g AS (SELECT part, coalesce(failed, '') AS failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l AS a, l AS b, l AS c, l AS d, l AS e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[: step - 1] AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
h AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS alone,
    len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(before, x))) > 0 AS gone
  FROM g, s),
r AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM h GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM r
"""
