"""Personal data, also in disguise: transducers normalise a text and keep, for each character, where it came from.

Three transducers run in turn: look-alike characters (full-width, mathematical, Greek and Cyrillic letters, digits of
other scripts, zero-width characters), spelled digits (English, German, French, Spanish) and disguised "@" and "."
("[at]", "(dot)", "name at host dot org"). The detectors for e-mail addresses, IPv4 addresses, payment cards and phone
numbers run on the source text (base spans) and on the normalised one; spans found there are mapped back to source
characters, and those that lie within a base span are left out.

Each document is judged by itself, in Arrow batches; the transducers run only on texts that a scan of the bytes finds
something for.

Edge cases: a null or empty text has no spans (and stays null or empty when redacted); numbers have any length (leading zeros
count for nothing), and runs of digits take time in proportion to their length; repeated rows are judged alike; other columns
are ignored, or carried along by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ALNUM, TextBlock

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- detectors

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts no dotted number starts none at its later digits either: without the first test a run of digits is
# tried from each of them.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def _is_byte(digits: str) -> bool:
    """Whether a number of any length is 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def _emails(text: str) -> Iterator[Span]:
    """As [local]+@[domain]+(.[domain]+)+ from left to right, but from one "@" to the next: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield "email", start, end.end()
            free = end.end()
        at = text.find("@", max(at + 1, free))


def detect(text: str) -> list[Span]:
    """All spans of the four kinds, by kind and start."""
    spans = list(_emails(text)) if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_is_byte, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


# ---------------------------------------------------------------- transducers

# Letters that look like ASCII ones (Cyrillic, then Greek).
_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Invisible characters; spelled digits.
_INVISIBLE = "­​‌‍⁠﻿"
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _characters() -> dict[int, str]:
    """Characters that stand for one ASCII character, by compatibility, as decimal digits or by look."""
    table = {}
    for code in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), *range(0x2070, 0x209D), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code))
        digit = unicodedata.decimal(chr(code), None)
        if digit is not None:
            table[code] = str(digit)
        elif len(plain) == 1 and plain.isascii():
            table[code] = plain
    return table | {ord(c): "" for c in _INVISIBLE} | {ord(k): v for k, v in _LOOKALIKES.items()}


_CHARACTERS = _characters()
_DISGUISED = re.compile(r"(?![\x00-\x7F])[" + "".join(map(re.escape, map(chr, _CHARACTERS))) + "]")
_ANY_DIGIT = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + r")(?!\w)"
_DIGIT_WORD = re.compile(r"(?<!\w)(?:plus\x20+(?=[0-9]|" + _ANY_DIGIT + ")|" + _ANY_DIGIT + ")", re.IGNORECASE)
_BRACKETED = re.compile(r"[\x20]?[\[({<][\x20]?(at|dot|@|\.)[\x20]?[\])}>][\x20]?", re.IGNORECASE)
_DOT = r"(?:\x20+dot\x20+|\.)"
# Top-level domains that make "name at host dot ..." an address rather than prose.
_TOP = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|eu|us|uk|ca|au|de|at|ch|fr|be|nl|es|it|pt|mx|ar|br|in|jp|cn|ru|pl|se|no|dk|fi|test|example|invalid"
_BARE = re.compile(r"(?<=[A-Za-z0-9._%+-])(\x20+at\x20+|@)(?=[A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)*?\x20+dot\x20+(?:" + _TOP + r")(?![A-Za-z0-9-]))", re.IGNORECASE)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\x20+(?:dot|point|punkt|punto)\x20+(?=[A-Za-z0-9])", re.IGNORECASE)


class Aligned:
    """A text, and for each of its characters the source characters [start, end) it came from."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def rewrite(self, pattern: re.Pattern, to) -> "Aligned":
        """Replaces the matches of a pattern; the characters of a replacement come from the whole match."""
        parts, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            s, e = m.span()
            parts += [self.text[last:s], new]
            starts += [self.starts[last:s], np.full(len(new), self.starts[s])]
            ends += [self.ends[last:s], np.full(len(new), self.ends[e - 1])]
            last = e
        if last:
            self.text = "".join([*parts, self.text[last:]])
            self.starts, self.ends = np.concatenate([*starts, self.starts[last:]]), np.concatenate([*ends, self.ends[last:]])
        return self

    def source(self, span: Span) -> Span:
        kind, s, e = span
        return kind, int(self.starts[s]), int(self.ends[e - 1])


def normalise(text: str) -> Aligned:
    """The three transducers one after the other."""
    out = Aligned(text).rewrite(_DISGUISED, lambda m: _CHARACTERS[ord(m[0])])
    out.rewrite(_DIGIT_WORD, lambda m: _SPELLED.get(m[0].lower(), "+"))
    out.rewrite(_BRACKETED, lambda m: "@" if m[1].lower() in ("at", "@") else ".")
    at = len(out.text)
    out.rewrite(_BARE, lambda m: "@")
    if len(out.text) != at or re.search(r"@[A-Za-z0-9-]+\x20+dot|[0-9]\x20+(?:dot|point|punkt|punto)\x20+[0-9]", out.text, re.IGNORECASE):
        out.rewrite(_BARE_DOT, lambda m: ".")
    return out


def hidden(text: str, base: list[Span]) -> list[Span]:
    """Spans of the source that only the normalised text shows."""
    aligned = normalise(text)
    found = dict.fromkeys(aligned.source(x) for x in detect(aligned.text))
    starts = sorted(s for _, s, _ in base)
    furthest = list(accumulate((e for _, _, e in sorted(base, key=lambda x: x[1])), max))

    def within_base(x: Span) -> bool:
        i = bisect_right(starts, x[1])
        return i > 0 and furthest[i - 1] >= x[2]

    return [x for x in found if not within_base(x)]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in _ordered(spans))


# ---------------------------------------------------------------- Spark side

_MARKED, _DIGITS, _BRACKETS, _INNER = np.zeros((4, 256), bool)
_MARKED[list(b"@+0123456789")] = _DIGITS[list(b"0123456789")] = _BRACKETS[list(b"[({<")] = _INNER[list(b"aAdD@.")] = True
# Latin letters and signs of two bytes that a transducer reads as others or as the end of a word: dotted and
# dotless i, long s, and the signs of multiplication and division.
_PAIRS = (b"\xc4\xb0", b"\xc4\xb1", b"\xc5\xbf", b"\xc3\x97", b"\xc3\xb7")
# Word hashes lower-case A-Z only.
_DIGIT_NAMES = sorted({v for w in _SPELLED for v in (w, "".join(c if c.isascii() else c.upper() for c in w))})


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(TextBlock(pa.array([" ".join(words)])).words(ALNUM).hashes(lower=True))


def _suspects(block: TextBlock) -> np.ndarray:
    """All texts that a transducer could change: they have characters beyond Latin letters, a spelled dot, an opening
    bracket before "at", "dot", "@" or ".", a digit word, or "plus" and a digit."""
    words = block.words(ALNUM)
    h = words.hashes(lower=True)
    has = lambda names: np.bincount(words.doc[np.isin(h, _word_hashes(names))], minlength=block.n) > 0
    odd = (block.bytes >= 0xC6) | (block.bytes == 0xC2)
    for first, second in _PAIRS:
        odd[1:] |= (block.bytes[1:] == second) & (block.bytes[:-1] == first)
    opens, inner = _BRACKETS[block.bytes], _INNER[block.bytes]
    bracketed = np.zeros(len(block.bytes), bool)
    bracketed[:-1] = opens[:-1] & inner[1:]
    bracketed[:-2] |= opens[:-2] & (block.bytes[1:-1] == ord(" ")) & inner[2:]
    plus = has(["plus"]) & (block.per_doc(_DIGITS[block.bytes]) > 0)
    return (block.per_doc(odd | bracketed) > 0) | plus | has(["dot", "point", "punkt", "punto", *_DIGIT_NAMES])


def _found(column: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """(text, base spans, hidden spans) of each row."""
    block = TextBlock(column)
    marked = block.per_doc(_MARKED[block.bytes]) > 0
    raw = block.bytes.tobytes()
    for s, e, is_marked, is_suspect in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), marked.tolist(), _suspects(block).tolist()):
        text = raw[s:e].decode("utf-8", "replace") if is_marked or is_suspect else ""
        base = detect(text) if is_marked else []
        yield text, base, hidden(text, base) if is_suspect else []


SPANS_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def spans(documents: DataFrame) -> DataFrame:
    """The number of base spans of each kind, their digest, all spans and their number, of each document row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, every, sizes = [], [], []
            for _, base, more in _found(batch.column("text")):
                for kind, c in zip(KINDS, counts):
                    c.append(sum(x[0] == kind for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(base + more))
                sizes.append(len(base) + len(more))
            columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, SPANS_SCHEMA)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, last = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, column: str = "text") -> DataFrame:
    """The documents with personal data replaced in a text column; all other columns stay."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, column):
            old = batch.column(column)
            texts = old.to_pylist()
            for i, (text, base, more) in enumerate(_found(old)):
                if base or more:
                    texts[i] = redacted(text, base + more)
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, old.type))

    return documents.mapInArrow(mask, documents.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return spans(common.documents(spark, sf_dir))
