"""Texts kept to what their sources say: sentences with numbers that no source has are dropped, headers stay; and five checks of a text.

All expressions. The lines of a text go through an automaton with two states, in one fold: a header line ends the paragraph before it and is a
block of its own; other lines are joined to paragraphs. Lines that are fences go first, and known headers within lines get lines of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TRIVIAL, cited_ids, in_sources

# Headers that stand within lines, what is said if nothing is left, and what a text must not hold.
HEADERS = ["Status", "Empirical evidence", "Modeled scenarios", "Policy context"]
NOTHING = "Could not produce a verifiable summary; see the data panels."
PLACEHOLDERS = ["<document", "</document", "[doc_id]"]
NUMBER = r"(?:^|(?<=[\s(\[/]))-?\d[\d,]*(?:\.\d+)?"
LEAST_CHARACTERS = 50

_FENCE = r"(?md)^\s*```[a-zA-Z]*\s*$"
_HEADER = r"^\s*\*\*[A-Z][A-Za-z\s/]+\.\*\*\s*$"
_SEGMENTS = "array<struct<header:boolean,text:string>>"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def without_fences(text: Column) -> Column:
    """The text without lines that are only a fence; fences within lines stay."""
    return _trimmed(F.regexp_replace(text, _FENCE, ""))


def split_headers(text: Column) -> Column:
    """The known headers, each on a line of its own."""
    apart = F.regexp_replace(text, rf"\*\*({'|'.join(HEADERS)})\.\*\*", "\n**$1.**\n")
    return _trimmed(F.regexp_replace(apart, r"\n{3,}", "\n\n"))


def segments(text: Column) -> Column:
    """Headers and the paragraphs between them, in order: array<struct<header, text>>."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f]", -1), lambda x: F.struct(x.rlike(_HEADER).alias("header"), _trimmed(x).alias("text")))

    def add(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.lit(False).alias("header"), F.concat(last.text, F.lit(" "), line.text).alias("text"))))
        return F.when((F.size(done) > 0) & ~line.header & ~F.coalesce(F.try_element_at(done, F.lit(-1)).header, F.lit(True)), joined).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(lines, F.array().cast(_SEGMENTS), add)


def ungrounded_numbers(sentence: Column, sources: Column) -> Column:
    """Numbers of a sentence, bold marks and citations aside, that the sources do not have; well-known small ones are none."""
    clean = F.regexp_replace(F.regexp_replace(sentence, r"\*\*([^*]+)\*\*", "$1"), r"(?i)\[[a-z0-9_]+\]", "")
    return F.filter(F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(0)), lambda n: ~n.isin(TRIVIAL) & ~in_sources(n, sources))


def haystack(documents: Column) -> Column:
    """The sources of an array<struct<doc_id, text>> as one text; that of the address itself is none, since its numbers prove nothing."""
    told = F.filter(documents, lambda d: ~d.doc_id.endswith("geocode"))
    return F.array_join(F.transform(told, lambda d: F.coalesce(d.text, F.lit(""))), "\n")


def judged(text: Column, sources: Column) -> Column:
    """array<struct<header, text, numbers>>: headers and sentences in order, with the numbers that the sources do not have. Null texts have none."""
    whole = segments(split_headers(without_fences(F.coalesce(text, F.lit("")))))
    cut = lambda body: F.filter(F.transform(F.split(_trimmed(body), r"(?<=[.!?])\s+(?=[A-Z\[])", -1), _trimmed), lambda s: s != "")
    one = lambda header, s, block, numbers: F.struct(header.alias("header"), s.alias("text"), block.alias("block"), numbers.alias("numbers"))
    none = F.array().cast("array<string>")
    each = F.transform(whole, lambda g, i: F.when(g.header, F.array(one(F.lit(True), g.text, i, none))).otherwise(F.transform(cut(g.text), lambda s: one(F.lit(False), s, i, ungrounded_numbers(s, sources)))))
    return F.flatten(each)


def grounded_text(sentences: Column) -> Column:
    """The text of what ``judged`` keeps: a line for each header and each paragraph; a fixed sentence if nothing is left."""
    kept = F.filter(sentences, lambda s: F.size(s.numbers) == 0)
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("block"))
    glue = lambda done, s: F.when(done.text == "", "").when(done.block == s.block, " ").otherwise("\n")
    text = F.aggregate(kept, start, lambda done, s: F.struct(F.concat(done.text, glue(done, s), s.text).alias("text"), s.block.alias("block")), lambda done: done.text)
    return F.when(text == "", NOTHING).otherwise(text)


def checks(text: Column, sources: Column, known: Column, n_uncited: Column) -> dict[str, Column]:
    """The five checks that a text must pass; known: the ids that may be cited; n_uncited: claims without a citation (see ``citations``)."""
    whole = F.coalesce(text, F.lit(""))
    free = ~F.lower(whole).contains("[source]")
    for phrase in PLACEHOLDERS:
        free = free & ~whole.contains(phrase)
    clean = F.regexp_replace(F.regexp_replace(whole, r"\*\*([^*]+)\*\*", "$1"), r"(?i)\[[a-z0-9_]+\]", "")
    numbers = F.filter(F.regexp_extract_all(clean, F.lit(r"\b-?\d[\d,]*(?:\.\d+)?\b"), F.lit(0)), lambda n: ~n.isin(TRIVIAL) & ~in_sources(n, sources))
    return {
        "non_empty": F.length(_trimmed(whole)) > LEAST_CHARACTERS, "numerics_grounded": F.size(numbers) == 0, "no_placeholder_tokens": free,
        "citations_dense": F.coalesce(n_uncited, F.lit(0)) == 0, "citations_resolve": F.size(F.array_except(cited_ids(whole), known)) == 0,
    }
