"""Substring dedup: suffix automata over earlier passages; documents stream through them for matching statistics.

A window of WINDOW words is removed where its word sequence also starts earlier. Windows that can be equal share an anchor
(see ``anchors``), so the corpus is cut into reference shards by anchor: the passages of an anchor, in document order, are
streamed through the automata of the passages before them; a matched length of WINDOW or more marks words as seen. A passage
with unseen windows then joins the automaton; beyond SHARD_WORDS words a new automaton is begun, and passages stream
through all of them. A passage that equals an earlier one word for word needs no automaton.

Hot groups are taken apart before the exchange. Equal passages of one task are folded: all but the first of them are seen, and
only that one is sent. The windows of an anchor with more than LARGE places are sent one by one, by their own hashes: those
within a passage that very many documents share fold like others, and those at its ends, all different, go to different parts.

Automata are not broadcast to all documents: that would stream each document through automata of the whole corpus. Each one
meets the passages that share its anchor. Passages are sent as text, and automata and folds compare the words themselves:
hashes only choose where passages meet.

Edge cases: a null or empty text has no words and loses none; rows with equal doc_id and text are one document; rows that
share a doc_id only follow one another by the hash of their texts; a null doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .anchors import anchors, identified, passes, repeated_filter, with_spans
from .common import SPACED, SpanHasher, TextBlock

WINDOW = 20
GRAM = 5
SHARD_WORDS = 100_000
PARTS = 4  # for each shuffle partition
#: Places of an anchor from which on its windows are dealt singly; passages that a task holds back to fold.
LARGE = 10_000
HELD = 50_000

PASSAGES = {"key": pa.uint64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "low": pa.int64(), "n": pa.int32()}
PASSAGES_SCHEMA = "part int, key binary, doc_id binary, text_hash binary, low binary, n binary, words binary, done binary"
SPANS_SCHEMA = "doc_id long, text_hash long, s long, e long"
_NULL = np.iinfo(np.int64).min


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.words = 0

    def _state(self, next_: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of p's strings followed by word, apart from longer strings of q."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes]) -> None:
        last, self.words = 0, self.words + len(words)
        for word in words:
            p = last
            q = self.next[p].get(word)
            if q is not None:
                last = self._split(p, word, q)
                continue
            new = self._state({}, 0, self.length[p] + 1)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._split(p, word, self.next[p][word])
            last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word: the length of the longest string that ends with it and is in the automaton."""
        next_, link, lengths = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in words:
            q = next_[state].get(word)
            while q is None and state:
                state = link[state]
                matched = lengths[state]
                q = next_[state].get(word)
            if q is not None:
                state, matched = q, matched + 1
            out.append(matched)
        return out


def seen_windows(passages: Iterator[list[bytes]], size: int, shard_words: int = SHARD_WORDS) -> Iterator[list[int]]:
    """For each passage, in order: its windows (by their first word) that an earlier passage has."""
    shards: list[SuffixAutomaton] = []
    known: set[tuple[bytes, ...]] = set()
    for words in passages:
        whole = tuple(words)
        n = len(words) - size + 1
        if whole in known:
            yield list(range(n))
            continue
        known.add(whole)
        seen: set[int] = set()
        for shard in shards:
            seen.update(i - size + 1 for i, length in enumerate(shard.statistics(words)) if length >= size)
        if len(seen) < n:
            if not shards or shards[-1].words >= shard_words:
                shards.append(SuffixAutomaton())
            shards[-1].add(words)
        yield sorted(seen)


# ---------------------------------------------------------------- Spark side


def _blocks(batch: pa.RecordBatch, size: int, gram: int):
    for piece in common.pieces(iter([batch]), most_bytes=2 << 20):
        words = TextBlock(piece.column("text")).words(SPACED)
        h = words.hashes()
        yield piece, words, h, anchors(h, words.first, size, gram)


class _Folder:
    """Passages of a task: the first of equal ones is kept, the others are done. Those that recur are held back to the end."""

    def __init__(self, parts: int):
        self.parts = parts
        self.held: dict[bytes, tuple] = {}

    def add(self, content: np.ndarray, columns: dict[str, np.ndarray], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((columns["low"], columns["text_hash"], columns["doc_id"], content))
        c = content[order]
        first = np.ones(len(order), bool)
        first[1:] = c[1:] != c[:-1]
        for i in np.flatnonzero(~first).tolist():
            if words[order[i]] != words[order[i - 1]]:  # different passages of equal hash: all are sent
                first[c == c[i]] = True
        leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        place = [columns[k] for k in ("doc_id", "text_hash", "low")]
        again = order[~first & np.logical_or.reduce([v[order] != v[leader] for v in place])]  # not the same place once more
        done = [np.stack([columns[k][again] for k in ("doc_id", "text_hash", "low")] + [columns["low"][again] + columns["n"][again]], 1)]
        lone = np.concatenate((first[1:], [True])) & first
        sent = []
        for i, alone in zip(order[first].tolist(), lone[first].tolist()):
            known = self.held.get(words[i])
            if alone and known is None:
                sent.append(i)
                continue
            mine = (int(columns["doc_id"][i]), int(columns["text_hash"][i]), int(columns["low"][i]), int(columns["key"][i]), int(columns["n"][i]), words[i])
            if known is None or mine[:3] < known[:3]:
                self.held[words[i]] = mine
                mine = known
            if mine is not None and mine[:3] != self.held[words[i]][:3]:
                done.append(np.array([[*mine[:3], mine[2] + mine[4]]], np.int64))
        at = np.array(sent, np.int64)
        yield from self._rows({k: v[at] for k, v in columns.items()}, [words[i] for i in sent], np.concatenate(done))
        if len(self.held) > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        held, self.held = list(self.held.values()), {}
        ids, texts, low, key, n, words = zip(*held) if held else ((),) * 6
        columns = {"key": np.array(key, np.uint64), "doc_id": np.array(ids, np.int64), "text_hash": np.array(texts, np.int64), "low": np.array(low, np.int64), "n": np.array(n, np.int32)}
        yield from self._rows(columns, list(words), np.zeros((0, 4), np.int64))

    def _rows(self, columns: dict[str, np.ndarray], words: list[bytes], done: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[bytes]] = {}
        part = (columns["key"] % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True]))) if len(part) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine = order[a:b]
            rows[int(part[mine[0]])] = [*[columns[k][mine].tobytes() for k in PASSAGES], b"\n".join(words[i] for i in mine.tolist()), b""]
        where = common.mix(done[:, 1].astype(np.uint64)) % np.uint64(self.parts)
        for p in np.unique(where).tolist():
            rows.setdefault(p, [b""] * (len(PASSAGES) + 2))[-1] = done[where == p].tobytes()
        if rows:
            yield pa.record_batch([pa.array(list(rows), pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*rows.values())]], names=["part", *PASSAGES, "words", "done"])


def passages(rows: DataFrame, size: int, gram: int, large: int = LARGE) -> DataFrame:
    """Passages around the anchors that the filter lets pass: the words of the windows of each, packed by part."""
    spark = rows.sparkSession
    filters = spark.sparkContext.broadcast(repeated_filter(rows, lambda batch: (a.key for *_, a in _blocks(batch, size, gram)), large))
    parts = PARTS * common.partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(parts)
        for batch in batches:
            for piece, words, h, found in _blocks(batch, size, gram):
                found = found.take(passes(filters.value[0], found.key))
                hot = passes(filters.value[1], found.key)
                single = common.ragged(found.low[hot], found.high[hot] - found.low[hot] + 1)
                hasher = SpanHasher(h)
                begin = np.concatenate((found.low[~hot], single))
                n = np.concatenate((found.high[~hot] - found.low[~hot] + size, np.full(len(single), size)))
                whole = hasher(begin, begin + n)
                key = np.concatenate((found.key[~hot], whole[len(begin) - len(single) :]))
                doc = words.doc[begin] if len(begin) else begin
                columns = {
                    "key": key, "doc_id": piece.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)[doc], "text_hash": piece.column("text_hash").to_numpy(zero_copy_only=False)[doc],
                    "low": begin - words.first[doc], "n": n.astype(np.int32),
                }
                # The words with one space between them.
                sizes = words.ends - words.starts
                place = np.cumsum(sizes + 1) - sizes - 1
                spaced = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
                spaced[common.ragged(place, sizes)] = words.block.bytes[common.ragged(words.starts, sizes)]
                raw = spaced.tobytes()
                texts = [raw[a:b] for a, b in zip(place[begin].tolist(), (place + sizes)[begin + n - 1].tolist())]
                yield from folder.add(common.mix(whole + key), columns, texts)
        yield from folder.flush()

    return rows.mapInArrow(cut, PASSAGES_SCHEMA)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part; they come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _judged(rows: list[dict], size: int) -> pa.RecordBatch:
    whole = {c: np.frombuffer(b"".join(r[c] for r in rows), kind.to_pandas_dtype()) for c, kind in PASSAGES.items()}
    words = [text for r in rows if r["words"] for text in r["words"].split(b"\n")]
    order = np.lexsort((whole["low"], whole["text_hash"], whole["doc_id"], whole["key"]))
    # Repeated rows are one document: each place counts once.
    again = np.ones(len(order), bool)
    again[:1] = False
    for c in ("key", "doc_id", "text_hash", "low"):
        again[1:] &= whole[c][order[1:]] == whole[c][order[:-1]]
    order = order[~again]
    key = whole["key"][order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    done = np.frombuffer(b"".join(r["done"] for r in rows), np.int64).reshape(-1, 4).T
    out: list[tuple[int, int, int]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        group = order[a:b]
        lists = (words[i].split() for i in group.tolist())
        for i, seen in zip(group.tolist(), seen_windows(lists, size)):
            begin = end = None
            for w in seen:
                if end is not None and w <= end:
                    end = w + size
                    continue
                if end is not None:
                    out.append((i, begin, end))
                begin, end = w, w + size
            if end is not None:
                out.append((i, begin, end))
    i, s, e = np.array(out, np.int64).reshape(-1, 3).T
    ids, texts, starts, ends = (np.concatenate(x) for x in zip((whole["doc_id"][i], whole["text_hash"][i], whole["low"][i] + s, whole["low"][i] + e), done))
    return pa.record_batch({"doc_id": pa.array(ids, mask=ids == _NULL), "text_hash": pa.array(texts), "s": pa.array(starts), "e": pa.array(ends)})


def repeated_spans(rows: DataFrame, size: int = WINDOW, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """Word spans (s, e) of ``identified`` documents that start earlier elsewhere; they may overlap."""
    found = passages(rows, size, gram, large).repartition(common.partitions(rows.sparkSession), "part").sortWithinPartitions("part")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_part(batches):
            yield _judged(part, size)

    return found.mapInArrow(judge, SPANS_SCHEMA)


KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def dedup(documents: DataFrame, size: int = WINDOW, large: int = LARGE) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space) of each document row."""
    rows = identified(documents)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                out, last = [], 0
                for span in spans:
                    if span["s"] > last:
                        out += words[last : span["s"]]
                    last = max(last, span["e"])
                out += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(rows, repeated_spans(rows, size, large=large)).mapInArrow(remove, KEPT_SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
