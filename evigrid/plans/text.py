"""Queries on text: sentences, compliance reports, grounding, citations, retrieval, addresses and question types."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import aggregates, spatial
from ..sources.shared import new_path
from .tables import load

#: Sentences that briefings are made of, so that each rule meets texts that keep and that break it.
SENTENCES = [
    "This briefing is automated and informational only.", "The address will flood in a storm.", "In the modeled storm it will flood.", "There is no risk here!", "Depth reached 3.25 ft [hwm] in 2021.",
    "FEMA flood map shows the zone.", "FIRM of 2013 shows it.", "It is probably 40% likely.", "Projected depth is large.", "Projected depth by 2050 is 2 ft [slr].", "No forecast data is available.",
    "That is rarer than a lightning strike.", "The pit is 2.1234 m deep (gauge).", "A 100-year flood is rare.", "It has a 1% annual chance.", "Sensor data was offline?", "About 1,250 people [pop] and 7 pumps.", "Cost 88.50 million (pop) [doc_id=hwm].",
]
SOURCES = "Depth 3.25 ft in 2021; 1250 people; zone of 2013; 88.5 million; horizon 2050"
IDS = ["gauge", "hwm", "pop", "slr"]
QUESTIONS = [
    "flood risk at 250 Broadway", "Is 80 Pioneer Street at risk of flooding?", "what's the flood risk for Red Hook", "Coney Island", "show me 12 Main St, Queens", "compare Gowanus vs Red Hook", "Should I worry about flooding at 5 Water St?",
    "Would it have flooded prior to Ida", "briefing on Astoria", "Do I need to disclose it", "sensor bk-12 just triggered", "new construction near Hunts Point", "prioritize pumps over walls for hardening", "insurance audit for 9 Bay Rd", "please check Harlem",
]


def _quote(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _briefings(spark, sf):
    """id, text and offline: five sentences for each supplier."""
    at = lambda i: F.get(F.array(*[F.lit(s) for s in SENTENCES]), ((F.col("s_suppkey") * (2 * i + 3) + i * i) % len(SENTENCES)).cast("int"))
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", *[at(i) for i in range(5)]).alias("text"), (F.col("s_suppkey") % 3 == 0).alias("offline"))


_AT = lambda i: f"{_quote(SENTENCES)}[CAST((s_suppkey * {2 * i + 3} + {i * i}) % {len(SENTENCES)} AS BIGINT) + 1]"
BRIEFINGS = f"(SELECT s_suppkey AS id, concat_ws(' ', {', '.join(_AT(i) for i in range(5))}) AS text, s_suppkey % 3 = 0 AS offline FROM supplier)"
_CUT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '')"


def sentence_split(spark, sf):
    """The sentences of each document, whatever its language, counted, with the longest."""
    docs = load(spark, sf, "documents").select("doc_id", t.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


SENTENCE_SPLIT = f"SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, {_CUT} AS s FROM documents)"


def compliance_report(spark, sf):
    """Which rules each briefing breaks, in order, and whether it keeps all."""
    b = _briefings(spark, sf)
    checks = [(r.name, t.passes(r, F.col("text"))) for r in t.RULES] + [("hundred_year_clarified", t.hundred_year_clarified(F.col("text"))), ("gap_disclosed", t.gap_disclosed(F.col("text"), F.col("offline")))]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    return b.select("id", F.array_join(F.array_sort(failed), ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


def _like(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _rule_sql(r: t.Rule) -> str:
    if r.need_any:
        return _like("lower(text)", r.need_any)
    quoted = lambda p: p.replace("'", "''")
    tests = [f"regexp_matches(lower(x), '{quoted(r.bad)}')"] + ([_like("lower(x)", r.bad_any)] if r.bad_any else [])
    tests += [f"NOT regexp_matches(lower(x), '{quoted(p)}')" for p in r.unless] + ([f"NOT {_like('lower(x)', r.unless_any)}"] if r.unless_any else [])
    return f"len(list_filter({_CUT}, lambda x: {' AND '.join(tests)})) = 0"


_CHECKS = {r.name: _rule_sql(r) for r in t.RULES} | {
    "hundred_year_clarified": f"(NOT regexp_matches(lower(text), '{t.HUNDRED_YEAR}') OR regexp_matches(lower(text), '{t.ONE_PERCENT}'))",
    "gap_disclosed": f"(NOT offline OR {_like('lower(text)', t.GAP)})",
}
_FAILED = "list_sort(list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _CHECKS.items()) + "], lambda x: x IS NOT NULL))"
COMPLIANCE = f"SELECT id, array_to_string(f, ',') AS failed, len(f) = 0 AS passed FROM (SELECT id, {_FAILED} AS f FROM {BRIEFINGS})"


def document_compliance(spark, sf):
    """Which rules each whole document breaks, how many figures it has, and what it cites."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    failed = F.array_union(t.failed_rules(t.RULES, F.col("text")), F.array_compact(F.array(F.when(~t.hundred_year_clarified(F.col("text")), F.lit("hundred_year_clarified")))))
    return d.select("doc_id", F.array_join(F.array_sort(failed), ",").alias("failed"), F.size(t.numbers(F.col("text"))).cast("long").alias("numbers"), F.array_join(t.cited_ids(F.col("text")), ",").alias("cited"))


def rule_totals(spark, sf):
    """How many briefings each rule fails, and how many sentences break it."""
    b = _briefings(spark, sf)
    counts = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.size(t.failed_sentences(r, F.col("text"))).alias("n")) for r in t.RULES if r.bad])
    return b.select(F.explode(counts).alias("c")).groupBy("c.rule").agg(F.count_if(F.col("c.n") > 0).alias("briefings"), F.sum("c.n").alias("sentences"))


_TOTAL = lambda r: _rule_sql(r)[: -len(" = 0")]
RULE_TOTALS = f"SELECT rule, count(*) FILTER (n > 0) AS briefings, CAST(sum(n) AS BIGINT) AS sentences FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{r.name}{chr(39)} AS rule, {_TOTAL(r)} AS n FROM {BRIEFINGS}' for r in t.RULES if r.bad)}) GROUP BY rule"


def numeric_grounding(spark, sf):
    """Numbers of each briefing that its sources do not have."""
    bad = t.invented_numbers(F.col("text"), F.lit(SOURCES))
    return _briefings(spark, sf).select("id", F.array_join(bad, ";").alias("invented"), (F.size(bad) == 0).alias("grounded"))


_NUMBERS = rf"list_filter(regexp_extract_all(regexp_replace(replace(text, '**', ''), '(?i)\[[a-z0-9_]+\]', '', 'g'), '{t.NUMBER}', 1), lambda n: n NOT IN ({', '.join(f'{chr(39)}{x}{chr(39)}' for x in t.TRIVIAL)}))"
_HAS = f"(contains('{SOURCES}', n) OR contains('{SOURCES}', replace(n, ',', '')) OR contains('{SOURCES}', CASE WHEN contains(n, '.') THEN regexp_replace(replace(n, ',', ''), '\\.?0+$', '') ELSE replace(n, ',', '') END))"
GROUNDING = f"SELECT id, array_to_string(b, ';') AS invented, len(b) = 0 AS grounded FROM (SELECT id, list_filter({_NUMBERS}, lambda n: NOT {_HAS}) AS b FROM {BRIEFINGS})"


_DOC_CHECKS = {n: c for n, c in _CHECKS.items() if n != "gap_disclosed"}
_DOC_FAILED = "list_sort(list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _DOC_CHECKS.items()) + "], lambda x: x IS NOT NULL))"
DOC_COMPLIANCE = rf"""
SELECT doc_id, array_to_string({_DOC_FAILED}, ',') AS failed, len({_NUMBERS}) AS numbers, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS cited
FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '\[([a-z][a-z0-9_]*)\]', 1) AS c FROM documents)"""


def ungrounded_drop(spark, sf):
    """The briefings without sentences that hold invented numbers."""
    kept = F.filter(t.sentences(F.col("text")), lambda s: F.size(t.invented_numbers(s, F.lit(SOURCES))) == 0)
    return _briefings(spark, sf).select("id", F.array_join(kept, " ").alias("text"), F.size(kept).cast("long").alias("n"))


_OWN = _NUMBERS.replace("replace(text,", "replace(x,")
UNGROUNDED = f"SELECT id, array_to_string(k, ' ') AS text, len(k) AS n FROM (SELECT id, list_filter({_CUT}, lambda x: len(list_filter({_OWN}, lambda n: NOT {_HAS})) = 0) AS k FROM {BRIEFINGS})"


def citations_resolve(spark, sf):
    """Citations after repair: those used, in order, and those that name no source."""
    fixed = t.repaired_citations(t.normalised_citations(F.col("text")), IDS)
    b = _briefings(spark, sf).select("id", t.cited_ids(fixed).alias("c"))
    known = F.array(*[F.lit(i) for i in IDS if i != "slr"])
    return b.select("id", F.array_join("c", ",").alias("cited"), F.array_join(F.array_except("c", known), ",").alias("unresolved"))


_CITED = rf"regexp_extract_all(regexp_replace(regexp_replace(text, '\[doc_id\s*=\s*([a-z][a-z0-9_]*)\]', '[\1]', 'g'), '\(({'|'.join(IDS)})\)', '[\1]', 'g'), '\[([a-z][a-z0-9_]*)\]', 1)"
CITATIONS = f"""
SELECT id, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda x: x NOT IN ('gauge', 'hwm', 'pop')), ',') AS unresolved
FROM (SELECT id, list_filter(r, lambda x, i: list_position(r, x) = i) AS c FROM (SELECT id, {_CITED} AS r FROM {BRIEFINGS}))"""


def citation_lookup(spark, sf):
    """Cited sources of all briefings with their titles: how often, and where first."""
    fixed = t.repaired_citations(t.normalised_citations(F.col("text")), IDS)
    used = _briefings(spark, sf).select("id", F.explode(t.cited_ids(fixed)).alias("doc_id"))
    titles = spark.createDataFrame([("hwm", "High-water marks"), ("pop", "Population")], "doc_id string, title string")
    return used.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", "doc_id"))


LOOKUP = f"""
SELECT doc_id, count(*) AS n, min(id) AS first_id, coalesce(any_value(title), doc_id) AS title FROM (
  SELECT DISTINCT id, unnest({_CITED}) AS doc_id FROM {BRIEFINGS}) LEFT JOIN (VALUES ('hwm', 'High-water marks'), ('pop', 'Population')) s(doc_id, title) USING (doc_id) GROUP BY doc_id"""


def chunk_documents(spark, sf):
    """Chunks of each document: whole sentences up to 700 characters."""
    return load(spark, sf, "documents").select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("chunk", "text"))


#: Sentences are numbered by the chunk that a running length puts them in.
CHUNKS = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_CUT} AS s FROM documents WHERE text IS NOT NULL),
r AS (SELECT id, doc_id, s, list_reduce(list_transform(s, lambda x: {{'n': length(x), 'c': [0::BIGINT]}}), lambda a, x: {{'n': CASE WHEN a.n + 1 + x.n <= 700 THEN a.n + 1 + x.n ELSE x.n END,
  'c': list_append(a.c, CASE WHEN a.n + 1 + x.n <= 700 THEN a.c[-1] ELSE a.c[-1] + 1 END)}}).c AS c FROM d WHERE len(s) > 0),
u AS (SELECT id, doc_id, unnest(s) AS s, unnest(c) AS chunk, generate_subscripts(s, 1) AS i FROM r)
SELECT doc_id, chunk, string_agg(s, ' ' ORDER BY i) AS text FROM u GROUP BY id, doc_id, chunk"""


def _normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


#: Vectors of a block that is asked, and of one that is searched; one vector in EVERY is a query.
ASKED, SEARCHED, EVERY = 256, 1024, 20


def _blocks(vectors, size: int, prefix: str):
    """The vectors, normalised, in rows of `size` at most: ids, labels and one binary of doubles, by id within a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, size) for i in range(0, len(whole), size)):
                ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
                order = np.argsort(ids, kind="stable")
                data = _normalised(np.array(batch.column("embedding").to_pylist(), np.float64))[order]
                yield pa.record_batch([pa.array([ids[order]], pa.list_(pa.int64())), pa.array([labels[order]], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], names=["ids", "labels", "data"])

    rows = vectors.select("vec_id", "label", "embedding").where("embedding IS NOT NULL").mapInArrow(pack, "ids array<long>, labels array<long>, data binary")
    return rows.select(*[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns])


def similar(spark, sf, every: int, keep: int):
    """(query, vec_id, label, score): of each query vector (one in `every`) the `keep` most similar vectors by cosine.

    Every block of query vectors meets every block of vectors in tasks, which pass on the best `keep` of each query; these
    are merged by query. Nothing is sent through the driver.
    """
    vectors = load(spark, sf, "embeddings")
    asked = _blocks(vectors.where(F.col("vec_id") % every == 0), ASKED, "q").hint("shuffle_replicate_nl")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                names, ids, labels = (np.array(row[c], np.int64) for c in ("q_ids", "v_ids", "v_labels"))
                matrix, rows = (np.frombuffer(row[c]).reshape(len(n), -1) for c, n in (("q_data", names), ("v_data", ids)))
                cosine = np.round(matrix @ rows.T, 9)
                cosine[names[:, None] == ids[None, :]] = -2
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :keep]
                query = np.repeat(np.arange(len(names)), best.shape[1])
                at = best.ravel()
                yield pa.record_batch({"query": pa.array(names[query]), "vec_id": pa.array(ids[at]), "label": pa.array(labels[at]), "score": pa.array(cosine[query, at])})

    met = _blocks(vectors, SEARCHED, "v").crossJoin(asked)
    found = met.mapInArrow(score, "query long, vec_id long, label long, score double").where("score > -2").withColumn("score", F.round("score", 9))
    return spatial.top_n(found, ["query"], [F.desc("score"), F.col("vec_id")], keep, "place")


def embedding_topk(spark, sf):
    """Dense retrieval: of the 15 most similar vectors those of score 0.05 or more, the best of each label, 5 at most."""
    cut = similar(spark, sf, EVERY, 15).where("score >= 0.05")
    one = aggregates.first_seen(cut, ["query", "label"], F.col("place"))
    return spatial.top_n(one, ["query"], [F.col("place")], 5).select("query", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


_COSINE = "round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 9)"
_SIMILAR = f"""
WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, v.label, {_COSINE} AS score FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id)"""
TOPK = f"""{_SIMILAR}, c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= 15),
o AS (SELECT * FROM c WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY place) = 1)
SELECT query, vec_id, label, row_number() OVER (PARTITION BY query ORDER BY place) AS rank, round(score, 6) AS score FROM o QUALIFY rank <= 5"""


def rerank(spark, sf):
    """Candidates by similarity (25, of score 0.05 or more), reordered by the share of the query's words that their document has,
    the best of each label, 5 at most. Vectors and documents go by one id."""
    path = new_path(spark, "candidates")
    similar(spark, sf, EVERY, 25).where("score >= 0.05").write.parquet(path)
    near = spark.read.parquet(path)
    # Only documents that a pair needs are cut into words.
    needed = near.select(F.col("query").alias("doc_id")).union(near.select("vec_id")).distinct()
    texts = load(spark, sf, "documents").select("doc_id", "text").join(needed, "doc_id", "left_semi")
    words = texts.select("doc_id", F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")), "").alias("words"))
    met = near.join(words.select(F.col("doc_id").alias("query"), F.col("words").alias("asked")), "query", "left").join(words.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    shared = F.size(F.array_intersect("asked", "words")) / F.greatest(F.size("asked"), F.lit(1))
    cut = met.select("query", "vec_id", "label", "place", F.round(F.coalesce(shared, F.lit(0.0)), 6).alias("second"))
    one = aggregates.first_seen(cut, ["query", "label"], F.struct(-F.col("second"), F.col("place")))
    return spatial.top_n(one, ["query"], [F.desc("second"), F.col("place")], 5).select("query", "vec_id", "label", "second", "rank")


RERANK = f"""{_SIMILAR}, w AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')), lambda x: x <> '') AS words FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= 25),
c AS (SELECT n.*, round(coalesce(CAST(len(list_intersect(a.words, b.words)) AS DOUBLE) / greatest(len(a.words), 1), 0), 6) AS second FROM n LEFT JOIN w a ON a.doc_id = query LEFT JOIN w b ON b.doc_id = vec_id),
o AS (SELECT * FROM c WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY second DESC, place) = 1)
SELECT query, vec_id, label, second, row_number() OVER (PARTITION BY query ORDER BY second DESC, place) AS rank FROM o QUALIFY rank <= 5"""

#: Entity patterns: label and regular expression with one group.
ENTITIES = [("date", r"\b((?:19|20)\d{2})\b"), ("percent", r"(\d+(?:\.\d+)?%)"), ("quantity", r"\b(\d[\d,]*(?:\.\d+)? (?:ft|m|people|million))\b"), ("agency", r"\b(FEMA|FIRM)\b")]


def entities(spark, sf):
    """Entities of the briefings by pattern, each once per briefing whatever its case, counted by label and text."""
    named = lambda label: lambda x: F.struct(F.lit(label).alias("label"), F.lower(x).alias("entity"))
    lists = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), named(label)) for label, p in ENTITIES]
    found = _briefings(spark, sf).select("id", F.explode(F.array_distinct(F.concat(*lists))).alias("e"))
    return found.groupBy("e.label", "e.entity").agg(F.count("*").alias("n"))


ENTITY = "SELECT label, entity, count(*) AS n FROM (" + " UNION ".join(f"SELECT id, '{label}' AS label, lower(unnest(regexp_extract_all(text, '{p}', 1))) AS entity FROM {BRIEFINGS}" for label, p in ENTITIES) + ") GROUP BY ALL"


def corpus_value(spark, sf):
    """What a search of the corpus gives each query: its hits of score 0.1 or more (3 at most), and the entities of their texts, each once."""
    hits = similar(spark, sf, EVERY, 3).where("score >= 0.1").select("query", F.col("vec_id").alias("doc_id"))
    texts = load(spark, sf, "documents").select("doc_id", "text").join(hits, "doc_id")
    named = lambda label: lambda x: F.struct(F.lit(label).alias("label"), F.lower(x).alias("entity"))
    lists = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), named(label)) for label, p in ENTITIES]
    found = texts.select("query", "doc_id", F.array_distinct(F.concat(*lists)).alias("e"))
    return found.groupBy("query").agg(F.count("*").alias("n_hits"), F.sum(F.coalesce(F.size("e"), F.lit(0))).alias("n_entities"), F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("documents"))


CORPUS_VALUE = f"""{_SIMILAR}, h AS (SELECT query, vec_id AS doc_id FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 3),
e AS (SELECT query, doc_id, coalesce(len(list_distinct(list_concat({", ".join(f"list_transform(regexp_extract_all(text, '{p}', 1), lambda x: '{label}:' || lower(x))" for label, p in ENTITIES)}))), 0) AS n FROM h JOIN documents USING (doc_id))
SELECT query, count(*) AS n_hits, CAST(sum(n) AS BIGINT) AS n_entities, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS documents FROM e GROUP BY query"""


def questions(spark, sf):
    """A question for each customer, with what is read from it."""
    at = F.get(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("c_custkey") % len(QUESTIONS)).cast("int"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), at.alias("query"))


_QUESTION = f"(SELECT c_custkey AS id, {_quote(QUESTIONS)}[CAST(c_custkey % {len(QUESTIONS)} AS BIGINT) + 1] AS query FROM customer)"


def address_extract(spark, sf):
    """The address in each question."""
    return questions(spark, sf).select("id", t.address(F.col("query")).alias("address"))


#: The address in each of QUESTIONS, by reading; where there is none, the question.
ADDRESSES = ["250 Broadway", "80 Pioneer Street", "Red Hook", None, "12 Main St, Queens", None, "5 Water St?", None, "Astoria", None, None, None, None, None, "Harlem"]
ADDRESS = f"SELECT id, coalesce({_quote([a or '' for a in ADDRESSES]).replace(chr(39) * 2, 'NULL')}[CAST(id % {len(ADDRESSES)} AS BIGINT) + 1], query) AS address FROM {_QUESTION}"


def intent_classify(spark, sf):
    """How many questions name a number (an address), compare, look back, or else name a neighbourhood."""
    q = F.lower("query")
    intent = F.when(q.rlike(r"\b(compare|vs)\b"), "compare").when(q.rlike(r"would it have|prior to"), "retrospective").when(q.rlike(r"\b\d+ [a-z]+"), "single_address").otherwise("neighborhood")
    return questions(spark, sf).groupBy(intent.alias("intent")).agg(F.count("*").alias("n"))


INTENT = rf"SELECT CASE WHEN regexp_matches(lower(query), '\b(compare|vs)\b') THEN 'compare' WHEN regexp_matches(lower(query), 'would it have|prior to') THEN 'retrospective' WHEN regexp_matches(lower(query), '\b\d+ [a-z]+') THEN 'single_address' ELSE 'neighborhood' END AS intent, count(*) AS n FROM {_QUESTION} GROUP BY ALL"


def heuristic_intent(spark, sf):
    """What each question is about, by the words in it."""
    return questions(spark, sf).select("id", t.heuristic_intent(F.col("query")).alias("intent"))


HEURISTIC = f"SELECT id, CASE WHEN id % {len(QUESTIONS)} IN (2, 3, 5, 8, 14) THEN 'neighborhood' ELSE 'single_address' END AS intent FROM {_QUESTION}"


def entity_backstops(spark, sf):
    """Amounts and fiscal years in chunks of reports (customers), each once, with the beginning of the chunk."""
    text = "concat('In FY 20', c_custkey % 10 + 10, '-', c_custkey % 10 + 11, ' it cost $', c_custkey % 7 + 1, '.5 million, later $', c_custkey % 7 + 1, '.5 MILLION and $2M (fiscal year 2019); ', repeat('more ', CAST(c_custkey % 60 AS INT)))"
    c = load(spark, sf, "customer").selectExpr("c_custkey AS id", f"{text} AS text").withColumn("e", t.backstops(F.col("text")))
    return c.select("id", F.size("e").cast("long").alias("n"), F.array_join(F.transform("e", lambda x: F.concat_ws(":", x.label, x.text)), "|").alias("entities"), F.length(t.excerpt(F.col("text"))).cast("long").alias("excerpt"))


BACKSTOPS = """
WITH c AS (SELECT c_custkey AS id, c_custkey % 10 + 10 AS y, c_custkey % 7 + 1 AS m, 'In FY 2010-11 it cost $1.5 million, later $1.5 MILLION and $2M (fiscal year 2019); ' AS shape, c_custkey % 60 * 5 AS more FROM customer)
SELECT id, 4 AS n, 'dollar_amount:$' || m || '.5 million|dollar_amount:$2M|date_range:FY 20' || y || '-' || (y + 1) || '|date_range:fiscal year 2019' AS entities,
  CASE WHEN length(shape) + more > 240 THEN 241 ELSE length(shape) + more END AS excerpt FROM c"""


def framing_classify(spark, sf):
    """The type of each question."""
    return questions(spark, sf).select("id", t.question_type(F.col("query"), F.lit("neighborhood")).alias("question_type"))


#: The type of each of QUESTIONS, by reading.
TYPES = [
    "generic_exposure", "generic_exposure", "generic_exposure", "journalism", "generic_exposure", "comparison", "habitability_decision", "retrospective", "journalism", "legal_disclosure", "emergency_response", "development_siting", "comparison",
    "underwriting", "journalism",
]
FRAMING = f"SELECT c_custkey AS id, {_quote(TYPES)}[CAST(c_custkey % {len(TYPES)} AS BIGINT) + 1] AS question_type FROM customer"


def place_resolve(spark, sf):
    """Names of places in the questions: an exact name before one inside the question, longer ones first; ties by name."""
    places = spark.createDataFrame([(p, i) for i, p in enumerate(["Red Hook", "Hook", "Coney Island", "Island", "Gowanus", "Astoria", "Harlem", "Hunts Point", "Queens"])], "place string, ord int")
    asked = questions(spark, sf)
    keyed = asked.select("id", t.normalised_name(F.col("query")).alias("q"))
    met = keyed.join(F.broadcast(places.withColumn("p", t.normalised_name(F.col("place")))), F.expr("contains(q, p)"))
    best = met.groupBy("id").agg(F.min_by("place", F.struct(F.col("q") != F.col("p"), -F.length("p"), "place")).alias("place"))
    return asked.select("id").join(best, "id", "left")


PLACES = f"""
WITH p AS (SELECT place, regexp_replace(lower(place), '[^a-z]+', '', 'g') AS p FROM (VALUES ('Red Hook'), ('Hook'), ('Coney Island'), ('Island'), ('Gowanus'), ('Astoria'), ('Harlem'), ('Hunts Point'), ('Queens')) v(place)),
q AS (SELECT id, regexp_replace(lower(query), '[^a-z]+', '', 'g') AS q FROM {_QUESTION}),
b AS (SELECT id, first(place ORDER BY q <> p, -length(p), place) AS place FROM q JOIN p ON contains(q, p) GROUP BY id) SELECT id, place FROM q LEFT JOIN b USING (id)"""


def event_leak(spark, sf):
    """Sources that a briefing cites although its plan did not list them, and listed ones it does not cite."""
    b = _briefings(spark, sf).select("id", t.cited_ids(F.col("text")).alias("fired"), F.when(F.col("id") % 2 == 0, F.array(F.lit("hwm"), F.lit("slr"))).otherwise(F.array(F.lit("pop"))).alias("listed"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return b.select("id", join(F.array_except("fired", "listed")).alias("leaked"), join(F.array_except("listed", "fired")).alias("silent"))


LEAK = rf"""
SELECT id, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(l, x))), ',') AS leaked, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(f, x))), ',') AS silent
FROM (SELECT id, list_distinct(regexp_extract_all(text, '\[([a-z][a-z0-9_]*)\]', 1)) AS f, CASE WHEN id % 2 = 0 THEN ['hwm', 'slr'] ELSE ['pop'] END AS l FROM {BRIEFINGS})"""

QUERIES = {
    "sentence_split": (sentence_split, SENTENCE_SPLIT), "compliance_report": (compliance_report, COMPLIANCE), "rule_totals": (rule_totals, RULE_TOTALS), "document_compliance": (document_compliance, DOC_COMPLIANCE), "numeric_grounding": (numeric_grounding, GROUNDING),
    "ungrounded_drop": (ungrounded_drop, UNGROUNDED), "citations_resolve": (citations_resolve, CITATIONS), "citation_lookup": (citation_lookup, LOOKUP), "chunk_documents": (chunk_documents, CHUNKS),
    "embedding_topk_one_per_doc": (embedding_topk, TOPK), "rerank": (rerank, RERANK), "entity_regex_dedupe": (entities, ENTITY), "corpus_value": (corpus_value, CORPUS_VALUE), "address_extract": (address_extract, ADDRESS),
    "intent_classify": (intent_classify, INTENT), "heuristic_intent": (heuristic_intent, HEURISTIC), "entity_backstops": (entity_backstops, BACKSTOPS), "framing_classify": (framing_classify, FRAMING), "place_resolve": (place_resolve, PLACES), "event_leak": (event_leak, LEAK),
}
