"""Helpers shared by the corpus operators: shared storage, and vectorised text scanning of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are words for "[^\x20\x09-\x0D]+" and for "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" after lower-casing A-Z.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Moduli (primes) of the span hash, and the base of each.
MODULI = ((2**31 - 1, 1_389_796_763), (2**31 - 19, 806_145_017))
_powers: dict[tuple[int, int], np.ndarray] = {}


# ---------------------------------------------------------------- storage


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset, in local mode only, one for this session."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        there = _own_dirs[app]
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all that the operators of this application stored in the shared folder; results that are not written yet go too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns it as read from there: this cuts the lineage.

    Rows of megabytes need ``group_bytes``, the size of a row group. Writers and readers hold a row group at a time, and writers
    look at its size after 100 rows at first, unless told to look after each.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base ** i modulo a prime below 2 ** 31, for i below n at least."""
    have = _powers.get((base, modulus), np.ones(1, np.uint32))
    while len(have) < max(n, 1 << 16):
        more = have * np.uint64(pow(base, len(have), modulus)) % np.uint64(modulus)
        have = np.concatenate((have, more.astype(np.uint32)))
    _powers[base, modulus] = have
    return have


class SpanHasher:
    """62-bit hashes of any spans of a sequence of integers, in constant time each after one pass.

    Polynomials modulo two primes: two spans of n integers that differ agree in both with a probability of about (n / 2**31)**2
    over the bases at the worst, and of 2**-62 if they are not made for it. (Modulo 2**64 there are spans that agree for any base.)
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = []
        small = values.dtype.itemsize == 1 and n < 1 << 24  # sums of products stay below 2 ** 63
        for modulus, base in MODULI:
            terms = np.multiply(values if small else values % np.uint64(modulus), powers(base, modulus, n)[:n], dtype=np.uint64)
            if not small:
                terms %= np.uint64(modulus)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._hashes((ends - starts).astype(np.uint64), [s[ends] - s[starts] for s in self.sums], lambda back: back[starts])

    def every(self, size: int) -> np.ndarray:
        """The hashes of all spans of a size, by their starts."""
        n = len(self.sums[0]) - size
        return self._hashes(np.full(1, size, np.uint64), [s[size:] - s[:n] for s in self.sums], lambda back: back[:n])

    def _hashes(self, length: np.ndarray, differences: list[np.ndarray], at) -> np.ndarray:
        out = None
        for (modulus, base), h in zip(MODULI, differences):
            back = powers(pow(base, -1, modulus), modulus, len(self.sums[0]))
            h %= np.uint64(modulus)
            h *= at(back)
            h %= np.uint64(modulus)
            out = h << np.uint64(31) if out is None else np.bitwise_or(out, h, out=out)
        out += length * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)


# ---------------------------------------------------------------- Arrow text batches


class TextBlock:
    """The texts of an Arrow column as one byte buffer; null texts are empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.string()), "")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4) if n else np.zeros(1, np.int32)
        data = column.buffers()[2]
        self.n = n
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets.astype(np.int64) - int(offsets[0])

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        return table[self.bytes]

    def words(self, table: np.ndarray) -> "Words":
        return Words(self, table)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


class Words:
    """Word spans of a block; words never cross texts. first[i]: number of words in the texts before text i."""

    def __init__(self, block: TextBlock, table: np.ndarray):
        inside = table[block.bytes]
        cut = np.zeros(len(inside) + 1, bool)
        cut[block.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, block.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(block.n), self.counts)
        self.block = block
        self.inside = inside

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = self.block.lowered() if lower else self.block.bytes
        return SpanHasher(data)(self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """Starts (word indexes) of the windows of `size` words that lie within one text."""
        at = np.arange(max(0, len(self.starts) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]]


def unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether two spans of bytes differ, pair by pair: for spans whose hashes agree."""
    n = ends - starts
    out = n != other_ends - others
    length = np.where(out, 0, n)
    differ = data[ragged(starts, length)] != data[ragged(others, length)]
    wrong = np.concatenate(([0], np.cumsum(differ)))
    to = np.concatenate(([0], np.cumsum(length)))
    return out | (wrong[to[1:]] > wrong[to[:-1]])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Splits batches so that each has at most `most_bytes` of text, or one row: bounds the memory of a task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most_bytes:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += size
        yield batch.slice(begin)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
