"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

A shard file is

    magic "TOKZ", version (u8), bytes an id takes (u8: 2 or 4), SHA-256 of the dictionary (32 bytes)
    the compressed documents one after the other
    the index: doc_id (i64, with a flag for null), place and size of the frame, number of ids, for each document
    number of documents (u64), place of the index (u64)

A reader checks the dictionary hash, finds a document in the index, and decompresses that one frame. Shards hold ascending
doc_id ranges. Tasks write them under names of their own attempt, and only the files in the manifest table count, so a task
that runs twice or dies leaves nothing that is read. Files go through pyarrow.fs to the folder all executors share.

The dictionary is trained on the serialized ids of at most DICTIONARY_DOCUMENTS documents, those with the smallest hashes
of their ids (of the texts that share an id, the one with the smallest hash), of each at most DICTIONARY_PIECES pieces of
DICTIONARY_PIECE bytes, equal ones once; it changes sizes only, never contents.

Edge cases: a null or empty text holds the end id alone; rows with equal doc_id follow one another, by a hash of the text; a null doc_id
comes first; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import PIECE_BYTES, encoder, vocabulary_path

DICTIONARY_DOCUMENTS = 1500
DICTIONARY_BYTES = 64 << 10
DICTIONARY_PIECE = 8 << 10
DICTIONARY_PIECES = 4
LEVEL = 3
END_ID = 1
_HEAD, _TAIL = struct.Struct("<4sBB32s"), struct.Struct("<QQ")
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("place", "<u8"), ("size", "<u4"), ("n", "<u8")])
MANIFEST_SCHEMA = "part int, path string, documents long, tokens long, bytes long, id_bytes long"
ROWS_SCHEMA = "part int, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


# ---------------------------------------------------------------- dictionary


def train_dictionary(documents: DataFrame, vocabulary: str, id_bytes: int) -> bytes:
    """A zstandard dictionary from serialized ids of a bounded sample; empty if there is too little to train on."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    one = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCUMENTS).collect()
    wanted = dict(map(tuple, chosen))
    sent = documents.sparkSession.sparkContext.broadcast((np.sort(np.array(list(wanted), np.int64)), wanted))

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        told: set[bytes] = set()  # of this task: at most those of the chosen documents
        for batch in common.pieces(batches, most_bytes=PIECE_BYTES):
            mine = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
            hit = [i for i in np.flatnonzero(np.isin(mine, ids)).tolist() if texts[mine[i]] == hashes[i]]
            if hit:
                data, counts = encoder(vocabulary).encode(batch.column("text").take(pa.array(hit)))
                raw, step = data.astype(f"<u{id_bytes}").tobytes(), np.cumsum(counts * id_bytes).tolist()
                new: list[bytes] = []
                for a, b in zip([0, *step], step):
                    parts = {raw[i : min(i + DICTIONARY_PIECE, b)] for i in range(a, b, DICTIONARY_PIECE)}
                    new += [x for x in sorted(parts, key=lambda x: hashlib.sha256(x).digest())[:DICTIONARY_PIECES] if x not in told]
                    told.update(new[-DICTIONARY_PIECES:])
                yield pa.record_batch({"sample": pa.array(new, pa.binary())})

    samples = [bytes(r[0]) for r in rows.mapInArrow(serialized, "sample binary").distinct().collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


# ---------------------------------------------------------------- files


class ShardWriter:
    def __init__(self, out, dictionary: bytes, id_bytes: int):
        self.out, self.id_bytes, self.place, self.tokens = out, id_bytes, _HEAD.size, 0
        self.index: list[tuple] = []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out.write(_HEAD.pack(b"TOKZ", 1, id_bytes, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.pack.compress(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.place, len(frame), len(ids)))
        self.place += len(frame)
        self.tokens += len(ids)

    def finish(self) -> int:
        data = np.array(self.index, _INDEX).tobytes()
        self.out.write(data)
        self.out.write(_TAIL.pack(len(self.index), self.place))
        return self.place + len(data) + _TAIL.size


class ShardReader:
    """Random access to the documents of a shard file."""

    def __init__(self, path: str, dictionary: bytes):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        magic, version, self.id_bytes, digest = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if (magic, version) != (b"TOKZ", 1):
            raise ValueError(f"{path} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        n, self.end = _TAIL.unpack(self.file.read_at(_TAIL.size, self.file.size() - _TAIL.size))
        self.index = np.frombuffer(self.file.read_at(n * _INDEX.itemsize, self.end), _INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document: one read and one frame."""
        row = self.index[i]
        return self._ids(self.file.read_at(int(row["size"]), int(row["place"])))

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The documents with an id; the index is sorted by it."""
        at = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null"] == 0))
        return [self.document(int(i)) for i in at]

    def __iter__(self) -> Iterator[np.ndarray]:
        for row in self.index:
            yield self._ids(self.file.read_at(int(row["size"]), int(row["place"])))


# ---------------------------------------------------------------- Spark side


class TokenFiles:
    """A manifest table of shard files, with their dictionary."""

    def __init__(self, manifest: DataFrame, dictionary: bytes):
        self.manifest, self.dictionary = manifest, dictionary

    def documents(self) -> DataFrame:
        """part, place, doc_id, start, n_tokens, ids_crc32 of each document, as read from the files."""
        shards = self.manifest.orderBy("part").collect()  # a row for each task that wrote
        starts, total = {}, 0
        for r in shards:
            starts[r["part"]] = total
            total += r["tokens"]
        dictionary = self.dictionary

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist()):
                    reader = ShardReader(path, dictionary)
                    n = reader.index["n"].astype(np.int64)
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader]
                    ids = pa.array(reader.index["doc_id"], pa.int64(), mask=reader.index["null"] > 0)
                    columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(len(n))), ids, pa.array(starts[part] + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())]
                    yield pa.record_batch(columns, names=["part", "place", "doc_id", "start", "n_tokens", "ids_crc32"])

        spread = self.manifest.select("part", "path").repartition(max(1, len(shards)), "part")
        return spread.mapInArrow(read, ROWS_SCHEMA)


def write(documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Writes the ids of all texts, each with the end id, in ascending doc_id order."""
    path = vocabulary or vocabulary_path()
    spark = documents.sparkSession
    id_bytes = 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = train_dictionary(documents, path, id_bytes)
    folder = common.new_path(spark, "tokens")

    def to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, writer = TaskContext.get().partitionId(), None, None
        for batch in common.pieces(batches, most_bytes=PIECE_BYTES):
            if writer is None:
                name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.tokz"
                system, place = _open(name)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                file = system.open_output_stream(place)
                writer = ShardWriter(file, dictionary, id_bytes)
            ids, counts = encoder(path).encode(batch.column("text"))
            ends = np.cumsum(counts)
            for doc_id, s, e in zip(batch.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist()):
                writer.add(doc_id, np.append(ids[s:e], np.uint32(end_id)))
        if writer is not None:
            size = writer.finish()
            file.close()
            row = {"part": part, "path": name, "documents": len(writer.index), "tokens": writer.tokens, "bytes": size, "id_bytes": writer.tokens * id_bytes}
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.record_batch([pa.array([v], kind) for v, kind in zip(row.values(), kinds)], names=list(row))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A second sort key splits a doc_id that very many rows share.
    ordered = rows.repartitionByRange(common.partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return TokenFiles(common.stored(ordered.mapInArrow(to_file, MANIFEST_SCHEMA), "manifest"), dictionary)


def op3(spark, sf_dir: str) -> DataFrame:
    return write(common.documents(spark, sf_dir)).documents().select("doc_id", "start", "n_tokens", "ids_crc32")
