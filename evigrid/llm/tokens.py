"""Token ids of whole texts, by a tokenizers vocabulary file, in Arrow batches.

The vocabulary drops white space and lower-cases, and never joins letters, digits and other ASCII characters in a token. So a
text's ids are those of its parts one after the other: its words, cut where these kinds of characters meet, with A-Z lowered.
Words that hold other characters, or ones that the vocabulary's pattern or its special tokens treat together, stay whole.
Each worker encodes a part when it first meets it, by the library, and keeps its ids; a bounded store, which starts anew when
full. Parts of letters alone go to the library many at a time: each ends with a token that ends a word.

A part of up to SHORT bytes is known by these bytes, a longer one by its hash; its bytes are then compared with those that the
ids were learnt from. Where they differ, the texts go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import SPACED, SpanHasher, TextBlock, ragged

#: Parts that a worker remembers, and parts of letters that are encoded as one text.
REMEMBERED = 1_000_000
TOGETHER = 200
#: Bytes of a part that are its key themselves.
SHORT = 7
#: Bytes of text that are encoded at once.
PIECE_BYTES = 2 << 20
_encoders: dict[str, "WordEncoder"] = {}

_KIND = np.full(256, 3, np.uint8)
_KIND[list(range(65, 91)) + list(range(97, 123))] = 1
_KIND[48:58] = 2
_WHOLE = np.zeros(256, bool)
_WHOLE[128:] = _WHOLE[list(b"'<|")] = True


#: By length, the bits of a part's first eight bytes that belong to it; none of a long one.
_OWN_BITS = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)] + [0], np.uint64)


def part_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key for each part (bytes and length of a short one, a hash with the top bit of a long one), the long parts and their bytes."""
    lengths = ends - starts
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    keys = eight[starts].view("<u8").ravel() & _OWN_BITS[np.minimum(lengths, SHORT + 1)]
    keys |= lengths.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(lengths > SHORT)
    sizes = lengths[long]
    spelled = data[ragged(starts[long], sizes)]
    ends_ = np.cumsum(sizes)
    keys[long] = SpanHasher(spelled)(ends_ - sizes, ends_) | np.uint64(1 << 63)
    return keys, long, spelled


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)  # of the bytes of each part
        self.bytes = np.zeros(0, np.uint8)

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_alone``, for parts of letters."""
        ids, _ = self._alone([" ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(parts):
            return self._alone(parts)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw, kinds = data.tobytes(), _KIND[data] != 1
        other = np.concatenate(([0], np.cumsum(kinds)))
        letters = other[ends] == other[starts]
        order = np.concatenate((np.flatnonzero(letters), np.flatnonzero(~letters)))
        parts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[order].tolist(), ends[order].tolist())]
        n = int(letters.sum())
        (a, n_a), (b, n_b) = self._together(parts[:n]), self._alone(parts[n:])
        lengths, order = np.concatenate((n_a, n_b)), np.argsort(order)
        begin = (len(self.ids) + np.cumsum(lengths) - lengths)[order]
        self.ids = np.concatenate((self.ids, a, b))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.lengths = np.insert(self.keys, at, keys), np.insert(self.starts, at, begin), np.insert(self.lengths, at, lengths[order])
        sizes = ends - starts
        self.begins = np.insert(self.begins, at, len(self.bytes) + np.cumsum(sizes) - sizes)
        self.bytes = np.concatenate((self.bytes, data[ragged(starts, sizes)]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        block = TextBlock(column)
        words = block.words(SPACED)
        held = np.concatenate(([0], np.cumsum(_WHOLE[block.bytes])))
        plain = held[words.ends] == held[words.starts]
        inside = np.zeros(len(block.bytes), bool)
        inside[ragged(words.starts[plain], (words.ends - words.starts)[plain])] = True
        data = np.where(inside, block.lowered(), block.bytes)
        kind = _KIND[data]
        cut = np.flatnonzero(inside[1:] & inside[:-1] & (kind[1:] != kind[:-1])) + 1
        cut = cut[np.searchsorted(words.starts, cut, "right") == np.searchsorted(words.starts, cut - 1, "right")]
        starts, ends = np.sort(np.concatenate((words.starts, cut))), np.sort(np.concatenate((words.ends, cut)))
        keys, long, spelled = part_keys(data, starts, ends)
        different, at, part = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(different) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.keys, different)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == different[known]
        if not known.all():
            new = at[~known]
            self._learn(data, starts[new], ends[new], different[~known])
            place = np.searchsorted(self.keys, different)
        if not np.array_equal(spelled, self.bytes[ragged(self.begins[place[part[long]]], (ends - starts)[long])]):
            ids, counts = self._alone(column.cast(pa.string()).fill_null("").to_pylist())
            self.forget()
            return ids, counts
        begin, lengths = self.starts[place][part], self.lengths[place][part]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[ragged(begin, lengths)], np.diff(sums[np.searchsorted(starts, block.offsets)])


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
