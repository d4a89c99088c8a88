"""Claims and the citations that cover them: which spans of a text hold a figure, but no source."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import TRIVIAL

_FIGURE = re.compile(r"\b-?\d[\d,]*(?:\.\d+)?\b")
_SOURCE = re.compile(r"\[[a-z][a-z0-9_]*\]")
_STOP = re.compile(r"\.(?=[\s)]|$)")
# What follows the number of a house.
_SUFFIXES = "St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Pl|Place|Dr|Drive|Ln|Lane|Ct|Court|Way|Sq|Square|Ter|Terrace|Pkwy|Parkway|Cir|Circle|Hwy|Highway|Plaza|Broadway"
_HOUSE = re.compile(rf"\s+(?:[A-Z][a-zA-Z]*\s+){{1,3}}(?:{_SUFFIXES})\b")


def _spans(text: str):
    """(begin, end) of each claim's span: its sentence, or the whole line of a list where it stands in one."""
    stops = [m.start() for m in _STOP.finditer(text)]
    lines = [0] + [m.end() for m in re.finditer("\n", text)]
    for figure in _FIGURE.finditer(text):
        if figure[0] in TRIVIAL or _HOUSE.match(text, figure.end()):
            continue
        at = figure.start()
        i = bisect_left(stops, at - 1)  # a stop and the character after it lie before the figure
        begin = at if text[at - 1 : at] == "." else stops[i - 1] + 2 if i else 0
        j = bisect_left(stops, at)
        end = stops[j] + 1 if j < len(stops) else len(text)
        k = bisect_right(lines, at)
        line = lines[k - 1], lines[k] - 1 if k < len(lines) else len(text)
        if text[slice(*line)].lstrip().startswith(("- ", "* ")):
            begin, end = min(begin, line[0]), max(end, line[1])
        yield begin, end


def uncited_spans(text: str | None) -> list[str]:
    """The spans that hold a figure but no citation, each once; bold marks are taken off first. None for a null or empty text.

    Well-known small numbers and the numbers of houses are no claims.
    """
    plain = re.sub(r"\*\*([^*]+)\*\*", r"\1", text or "")
    bare = [plain[a:b].strip() for a, b in dict.fromkeys(_spans(plain)) if not _SOURCE.search(plain, a, b)]
    return bare


def with_uncited(rows: DataFrame, column: str = "text", name: str = "uncited") -> DataFrame:
    """The rows with the uncited spans of a text column."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: frame[column].map(uncited_spans)})

    return rows.mapInPandas(search, StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))]))
