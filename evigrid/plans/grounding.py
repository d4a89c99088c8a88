"""Queries on whole documents held against sources: sentences kept, and the five checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, grounding
from ..functions.text import TRIVIAL
from .tables import load

#: What a document's sources say: its first characters, and a figure. Its briefing has a fence, a header within a line, and an end that is half true.
_SOURCES = "concat(substr(coalesce(text, ''), 1, 300), ' 12345; 77.5')"
_BRIEFING = "concat('```', chr(10), 'Intro has 12,345. **Status.** ', coalesce(text, ''), chr(10), '**Policy context.**', chr(10), 'Cost was 77.50 [pop]. In 2031 it was 9,999 [pop]! A **77.5** stays', chr(10), '```')"


def _texts(spark, sf):
    return load(spark, sf, "documents").selectExpr("doc_id", f"{_SOURCES} AS sources", f"{_BRIEFING} AS briefing")


def grounded_documents(spark, sf):
    """Each document as a briefing without the sentences whose numbers its sources do not have: sentences kept and dropped, the numbers, and the text's digest."""
    b = _texts(spark, sf).withColumn("s", grounding.judged(F.col("briefing"), F.col("sources")))
    dropped = F.filter("s", lambda x: F.size(x.numbers) > 0)
    return b.select(
        "doc_id", F.size(F.filter("s", lambda x: x.header)).cast("long").alias("headers"), F.size(dropped).cast("long").alias("dropped"), F.array_join(F.flatten(F.transform(dropped, lambda x: x.numbers)), ";").alias("numbers"),
        F.md5(grounding.grounded_text(F.col("s"))).alias("digest"),
    )


def _sql() -> str:
    trivial = ", ".join(f"'{x}'" for x in TRIVIAL)
    has = lambda n: f"(contains(sources, {n}) OR contains(sources, replace({n}, ',', '')) OR contains(sources, CASE WHEN contains({n}, '.') THEN regexp_replace(replace({n}, ',', ''), '\\.?0+$', '') ELSE replace({n}, ',', '') END))"
    clean = r"regexp_replace(regexp_replace(s, '\*\*([^*]+)\*\*', '\1', 'g'), '(?i)\[[a-z0-9_]+\]', '', 'g')"
    numbers = rf"list_filter(regexp_extract_all({clean}, '(?:^|[\s(\[/])(-?\d[\d,]*(?:\.\d+)?)', 1), lambda n: n NOT IN ({trivial}) AND NOT {has('n')})"
    return rf"""
WITH d AS (SELECT doc_id, {_SOURCES} AS sources, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, sources, 1 AS block, 'Intro has 12,345.' AS body FROM d
  UNION ALL SELECT doc_id, sources, 2, '**Status.**' FROM d
  UNION ALL SELECT doc_id, sources, 3, array_to_string(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\f]'), lambda x: trim(x, ' ' || chr(9))), ' ') FROM d
  UNION ALL SELECT doc_id, sources, 4, '**Policy context.**' FROM d
  UNION ALL SELECT doc_id, sources, 5, 'Cost was 77.50 [pop]. In 2031 it was 9,999 [pop]! A **77.5** stays' FROM d),
u AS (SELECT doc_id, sources, block, body, unnest(list_transform(string_split(regexp_replace(trim(body, ' ' || chr(9)), '([.!?])\s+([A-Z\[])', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x, i: {{'s': trim(x, ' ' || chr(9)), 'i': i}})) AS x FROM b),
s AS (SELECT doc_id, sources, block, x.i AS i, x.s AS s, block IN (2, 4) AS header FROM u WHERE x.s <> ''),
n AS (SELECT *, CASE WHEN header THEN [] ELSE {numbers} END AS numbers FROM s),
k AS (SELECT doc_id, block, string_agg(s, ' ' ORDER BY i) AS line FROM n WHERE len(numbers) = 0 GROUP BY doc_id, block),
t AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY block)) AS digest FROM k GROUP BY doc_id)
SELECT n.doc_id, count(*) FILTER (header) AS headers, count(*) FILTER (len(numbers) > 0) AS dropped,
  coalesce(string_agg(array_to_string(numbers, ';'), ';' ORDER BY block, i) FILTER (len(numbers) > 0), '') AS numbers, first(digest) AS digest
FROM n JOIN t USING (doc_id) GROUP BY n.doc_id"""


def acceptance(spark, sf):
    """The five checks of each document as a briefing, and whether it is accepted: by hand-written cases in the tests, claims by spans of text."""
    b = citations.with_uncited(_texts(spark, sf).select("doc_id", "sources", F.col("briefing")), "briefing")
    found = grounding.checks(F.col("briefing"), F.col("sources"), F.array(F.lit("pop"), F.lit("hwm")), F.size("uncited"))
    every = F.lit(True)
    for c in found.values():
        every = every & c
    return b.select("doc_id", *[c.alias(n) for n, c in found.items()], every.alias("accepted"))


QUERIES = {"grounded_documents": (grounded_documents, _sql()), "acceptance_checks": (acceptance, None)}
