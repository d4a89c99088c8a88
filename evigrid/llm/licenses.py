"""License scans in DataFrame functions only: fixed phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of a document, or as many adjacent words as the template has, on whatever lines (so that wrapped notices
are found), as its set of words. A template is found in a block that contains at least THRESHOLD of the template's words.
A template that is itself a fixed phrase is looked for in lines only: across lines the phrase gives its label. The words of the templates are ordered by their frequency in the whole corpus, rare ones first.
A block can only reach the threshold if it has one of the first |T| - need + 1 words of template T (prefix filter), at
least ``need`` words (length filter), and enough words after the first shared one on both sides (positional filter). What is left
is verified by the exact overlap. The templates are a parameter of bounded size, so they go into the plan as literals: the
documents are read twice (word frequencies, then the join) and never shuffled.

Windows of adjacent words are taken only around the prefix words of texts with a line break.

Words are lower-cased by ``lower``; beyond A-Z that only changes letters that no phrase has.

Edge cases: a null or empty text has no words and no labels, and a score of 0; repeated rows are judged alike; a text with
many lines has its lines filtered in place, row by row; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: phrase: label, of the fixed rules.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: sentences of license texts and their notices. Where versions differ in a number only, the label is that of the family.
TEMPLATES = {
    "agpl-3.0": ["gnu affero general public license version 3"],
    "apache-2.0": [
        "licensed under the apache license version 2 0", "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "cc-by-4.0": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "mit": [
        "released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "reserved": ["all rights reserved"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
}
THRESHOLD = 0.9

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _need(template: list[str], threshold: float) -> int:
    """The least overlap that reaches the threshold."""
    return math.ceil(round(threshold * len(template), 9))


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(text.split()))) for label, texts in templates.items() for text in texts]


def _spaced(text: Column) -> Column:
    """The words of a text, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), _SEPARATORS, " "))


def _words(spaced: Column) -> Column:
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def frequencies(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary occurs in the whole corpus."""
    words = documents.select(F.explode(F.split(_spaced(F.col("text").cast("string")), " ", -1)).alias("word"))
    found = words.where(F.col("word").isin(vocabulary)).groupBy("word").count().collect()  # at most the vocabulary
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in found}


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _phrase(doubled: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase, and the words before the first and after the last one; each word stands between two spaces."""
    parts = F.split(doubled, " " + phrase.replace(" ", "  ") + " ", -1)
    words = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
    return (F.size(parts) - 1).cast("long"), words(F.get(parts, F.lit(0))), words(F.element_at(parts, -1))


def _containment(blocks: Column, around: Column, template: list[str], length: int, threshold: float) -> Column:
    """The largest containment of a template in the blocks (words in global order), or in `length` adjacent words of the
    stretches (words in order of text; not if 0), that reaches the threshold, else 0."""
    need, mine = _need(template, threshold), _literals(template)

    def passes(b: Column) -> Column:
        shared = F.get(F.array_intersect(mine, b), F.lit(0))
        after = F.least(F.lit(len(template)) - F.array_position(mine, shared), F.size(b) - F.array_position(b, shared))
        return (F.size(b) >= need) & F.arrays_overlap(b, _literals(template[: len(template) - need + 1])) & (after + 1 >= need)

    overlap = lambda b: F.size(F.array_intersect(mine, b))
    overlaps = F.transform(F.filter(blocks, passes), overlap)
    if length:
        starts = lambda c: F.sequence(F.lit(1), F.greatest(F.size(c) - length + 1, F.lit(1)))
        close = F.filter(around, lambda c: overlap(c) >= need)
        overlaps = F.concat(overlaps, F.flatten(F.transform(close, lambda c: F.transform(starts(c), lambda i: overlap(F.slice(c, i, length))))))
    most = F.coalesce(F.array_max(overlaps), F.lit(0))
    return F.when(most >= need, most / F.lit(len(template))).otherwise(F.lit(0.0))


def scan(documents: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found (label: containment) of each row."""
    sets = template_sets(templates)
    count = frequencies(documents, sorted({w for _, t in sets for w in t}))
    vocabulary = sorted(count, key=lambda w: (count[w], w))
    sets = [(label, sorted(t, key=vocabulary.index)) for label, t in sets]
    lengths = [0 if text in PHRASES else len(text.split()) for texts in templates.values() for text in texts]
    reach = max(lengths, default=0)
    prefixes = sorted({w for _, t in sets for w in t[: len(t) - _need(t, threshold) + 1]})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _spaced(text).alias("spaced"))
    rows = rows.withColumn("words", F.split("spaced", " ", -1)).withColumn("n_words", F.when(F.col("spaced") == "", 0).otherwise(F.size("words")).cast("long"))
    rows = rows.withColumn("near", F.arrays_overlap("words", _literals(prefixes)))
    has_phrase = F.lit(False)
    for phrase in PHRASES:
        has_phrase = has_phrase | F.col("spaced").contains(phrase)
    doubled = F.when(has_phrase, F.concat(F.lit(" "), F.replace("spaced", F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(F.lit(""))
    # Blocks of candidate documents, each as its template words in global order.
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.array_intersect(_literals(vocabulary), F.split(_spaced(line), " ", -1)))
    blocks = F.when(F.col("near"), F.filter(lines, lambda b: F.arrays_overlap(b, _literals(prefixes)))).otherwise(F.array().cast("array<array<string>>"))
    # The words on both sides of each prefix word, as far as a window that holds it can reach.
    places = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(prefixes), i + 1)))
    stretches = F.transform(places, lambda p: F.slice("words", F.greatest(p - (reach - 1), F.lit(1)), F.least(p, F.lit(reach)) + (reach - 1)))
    around = F.when(F.col("near") & F.col("text").contains("\n"), stretches).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.select("doc_id", "n_words", doubled.alias("doubled"), blocks.alias("blocks"), around.alias("around"))

    places, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        n, before, after = _phrase(F.col("doubled"), phrase)
        places = places + n
        firsts.append(F.when(n > 0, before))
        lasts.append(F.when(n > 0, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    found = [F.struct(F.lit(label).alias("label"), _containment(F.col("blocks"), F.col("around"), t, n, threshold).alias("score")) for (label, t), n in zip(sets, lengths)]
    rows = rows.select(
        "doc_id", "n_words", places.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        F.when(F.size("blocks") > 0, F.filter(F.array(*found), lambda x: x.score > 0)).otherwise(F.array().cast("array<struct<label:string,score:double>>")).alias("found"),
    )
    every = F.array_sort(F.array_union("base", F.transform("found", lambda x: x.label)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.score)), F.lit(0.0)).alias("score"), "found",
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("found")


def op8_sql(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows without any filter: every template against every line."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    starts = {label: f"list_filter(range(n_words), lambda i: {' AND '.join(f'words[i + {k}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(phrase.split(), 1))})" for phrase, label in PHRASES.items()}
    values = ", ".join(f"('{label}', {quoted(t)}, {_need(t, threshold)})" for label, t in template_sets(templates))
    bases = "list_concat(" + ", ".join(f"CASE WHEN len({x}) > 0 THEN ['{label}'] ELSE [] END" for label, x in starts.items()) + ")"
    places = "list_concat(" + ", ".join(starts.values()) + ")"
    word_list = lambda text: f"list_filter(regexp_split_to_array(lower({text}), '{_SEPARATORS}'), lambda w: w <> '')"
    return re.sub(r"\s+", " ", f"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT id, doc_id, {word_list("text")} AS words, len({word_list("text")}) AS n_words FROM d),
        b AS (SELECT id, doc_id, n_words, {places} AS places, {bases} AS base FROM w),
        t(label, words, need) AS (VALUES {values}),
        lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
        blocks AS (SELECT id, {word_list("line")} AS words FROM lines),
        hits AS (SELECT id, label, len(list_intersect(t.words, blocks.words)) / len(t.words) AS score FROM blocks, t WHERE len(list_intersect(t.words, blocks.words)) >= need),
        best AS (SELECT id, list(DISTINCT label) AS found, max(score) AS score FROM hits GROUP BY id)
        SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
          array_to_string(list_sort(base), ',') AS base_labels,
          array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels, coalesce(score, 0.0) AS score
        FROM b LEFT JOIN best USING (id)""".replace(chr(10), " "))
