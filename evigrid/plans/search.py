"""Search queries: vectors by an approximate index, places by misspelt names, areas by their names."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import narrative
from ..operators import lookup, names, vectors
from .tables import load, points, points_sql
from .text import _COSINE, EVERY, similar

INDEX_K = 10


def _indexed(spark, sf):
    table = load(spark, sf, "embeddings")
    made = vectors.fit(table)
    return table, table.where(F.col("vec_id") % EVERY == 0), made, vectors.build(table, made)


def vector_index_topk(spark, sf):
    """Of each query vector (one in 20) the ten most similar vectors that the approximate index finds, by exact cosine."""
    table, asked, made, blocks = _indexed(spark, sf)
    return vectors.search(blocks, made, table, asked, INDEX_K)


def vector_index_audit(spark, sf):
    """The index against exact search: indexed vectors, those in one list only, queries, true neighbours, and whether the recall is 0.9
    or more with a part of all codes looked at."""
    table, asked, made, blocks = _indexed(spark, sf)
    true = similar(spark, sf, EVERY, INDEX_K).select("query", "vec_id")
    found = vectors.search(blocks, made, table, asked, INDEX_K).select("query", "vec_id", F.lit(1).alias("hit"))
    recall = true.join(found, ["query", "vec_id"], "left").agg(F.count("*").alias("n_true"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*") >= 0.9).alias("recall_reached"))
    ids = blocks.select(F.explode(F.expr("transform(sequence(0, CAST(length(ids) / 8 AS INT) - 1), i -> substring(ids, 8 * i + 1, 8))")).alias("id"))
    listed = ids.groupBy("id").count().agg(F.sum("count").alias("n_indexed"), F.sum(F.when(F.col("count") == 1, 1).otherwise(0)).alias("n_in_one_list"))
    share = vectors.scanned_share(blocks, made, asked)
    more = [recall.select(c).scalar().alias(c) for c in recall.columns]
    return listed.select("n_indexed", "n_in_one_list", asked.select(F.count("*")).scalar().alias("n_queries"), *more, F.lit(share < 1).alias("part_scanned"))


AUDIT = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query, v.vec_id, {_COSINE} AS score FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, v.vec_id) <= {INDEX_K})
SELECT (SELECT count(*) FROM v) AS n_indexed, (SELECT count(*) FROM v) AS n_in_one_list, (SELECT count(*) FROM v WHERE vec_id % {EVERY} = 0) AS n_queries,
  (SELECT count(*) FROM s) AS n_true, true AS recall_reached, true AS part_scanned"""

# ---------------------------------------------------------------- places by name

AREA = (-74.10, 40.60, -73.90, 40.80)
#: A gazetteer of the parts, a tenth of it abroad; and what customers ask for: names with a character left out, doubled, exchanged or two of these.
_NAME = "concat(p_name, ' ', p_brand, ' ', lower(p_type))"
_PLACE_ID = "p_partkey + 50000"
_WRONG = """CASE c_custkey % 6 WHEN 0 THEN name WHEN 1 THEN concat(substr(name, 1, spot - 1), substr(name, spot + 1)) WHEN 2 THEN concat(substr(name, 1, spot), substr(name, spot))
  WHEN 3 THEN concat(substr(name, 1, spot - 1), 'x', substr(name, spot + 1)) WHEN 4 THEN concat(substr(name, 2, spot - 1), 'q', substr(name, spot + 1)) ELSE upper(concat(name, '!?')) END"""
_ASKED_AT = "CAST(3 + c_custkey % 5 AS INT)"
_HINT = "CASE WHEN c_custkey % 7 = 0 THEN 'what about it, in London' END"


def _gazetteer(spark, sf):
    more = [f"{_NAME} AS name", "p_partkey", "CASE WHEN p_size % 10 = 0 THEN 'gb' ELSE 'us' END AS country"]
    return points(load(spark, sf, "part"), "p_partkey", 50000, *more)


def place_lookup(spark, sf):
    """The place that each misspelt name of a customer's question means."""
    places = _gazetteer(spark, sf)
    customers = load(spark, sf, "customer").select("c_custkey")
    named = customers.join(places.selectExpr("p_partkey AS k", "name"), F.expr("c_custkey % 1000 = k"), "left").withColumn("spot", F.expr(_ASKED_AT))
    asked = named.selectExpr("c_custkey AS id", f"{_WRONG} AS text", f"{_HINT} AS hint")
    return lookup.resolve(asked, places.withColumnRenamed("id", "record_id"), AREA).select("id", "branch", "record_id", "distance")


def _lookup_sql() -> str:
    plain = lambda c: f"trim(regexp_replace(lower({c}), " + r"'[^\p{L}\p{N}]+', ' ', 'g'))"
    foreign = narrative.FOREIGN.replace("'", "''")
    inside = f"(country = 'us' AND lon BETWEEN {AREA[0]} AND {AREA[2]} AND lat BETWEEN {AREA[1]} AND {AREA[3]})"
    records = points_sql("part", "p_partkey", 50000, f"{_NAME} AS name, p_partkey, CASE WHEN p_size % 10 = 0 THEN 'gb' ELSE 'us' END AS country")
    return f"""
WITH r AS (SELECT *, {plain("name")} AS n FROM {records}),
a AS (SELECT c_custkey AS id, {_WRONG} AS text, {_HINT} AS hint FROM (SELECT c_custkey, name, {_ASKED_AT} AS spot FROM customer LEFT JOIN r ON c_custkey % 1000 = p_partkey)),
q AS (SELECT id, {plain("text")} AS q, coalesce(regexp_matches(text, '{foreign}'), false) OR coalesce(regexp_matches(hint, '{foreign}'), false) AS gate FROM a),
d AS (SELECT q, n, levenshtein(q, n) AS distance FROM (SELECT DISTINCT q FROM q WHERE q <> '') CROSS JOIN (SELECT DISTINCT n FROM r)
  WHERE levenshtein(q, n) <= CASE WHEN length(q) < 4 THEN 0 WHEN length(q) < 8 THEN 1 ELSE 2 END),
m AS (SELECT q.id AS asked, gate, distance, d.n, r.id, country, {inside} AS inside FROM q JOIN d USING (q) JOIN r ON r.n = d.n),
b AS (SELECT asked, first(country ORDER BY distance, n, id) AS best FROM m GROUP BY asked),
c AS (SELECT asked, inside, id, distance FROM m WHERE country = 'us' QUALIFY row_number() OVER (PARTITION BY asked ORDER BY NOT inside, distance, n, id) = 1)
SELECT q.id, CASE WHEN out THEN 'abroad' WHEN c.id IS NULL THEN 'none' WHEN inside THEN 'region' ELSE 'national' END AS branch,
  CASE WHEN NOT out THEN c.id END AS record_id, CASE WHEN NOT out THEN distance END AS distance
FROM (SELECT q.id, gate AND coalesce(best <> 'us', true) AS out FROM q LEFT JOIN b ON b.asked = q.id) AS q LEFT JOIN c ON c.asked = q.id"""


# ---------------------------------------------------------------- names of areas

# A gazetteer of the benchmark: an item is an area named by its first two words; the next two are its parent's name.
_WORDS = "split(lower(regexp_replace(text, '[^A-Za-z]+', ' ')), ' ')"
_AREAS = "SELECT item_id AS code, concat(upper(substr(w[0], 1, 1)), substr(w[0], 2), ' ', w[1]) AS name, concat('Borough ', item_id % 5) AS borough, concat(w[2], ' ', w[3]) AS parent, w FROM (SELECT item_id, {words} AS w FROM {table})"
_ALIASES = "SELECT concat(w[4], ' ', w[5]) AS alias, name FROM {areas} WHERE code % 2 = 0"
_BOROUGHS = "SELECT concat(w[6], ' ', w[7]) AS key, borough, code AS ord FROM {areas} WHERE code % 4 = 1"
_QUERIED = "SELECT code AS id, CASE code % 6 WHEN 0 THEN concat(' ', w[4], ' ', w[5]) WHEN 1 THEN upper(concat(w[6], ' ', w[7])) WHEN 2 THEN upper(name) WHEN 3 THEN substr(name, 2, 5) WHEN 4 THEN substr(parent, 2, 4) ELSE concat(name, 'qq') END AS query FROM {areas}"


def _area_tables(spark, sf):
    load(spark, sf, "benchmark").createOrReplaceTempView("benchmark_items")
    spark.sql(_AREAS.format(words=_WORDS, table="benchmark_items")).createOrReplaceTempView("benchmark_areas")
    areas, aliases, boroughs, asked = (spark.sql(q.format(areas="benchmark_areas")) for q in ("SELECT * FROM {areas}", _ALIASES, _BOROUGHS, _QUERIED))
    # A key of several rows goes by the first of them.
    one = lambda df, key, *order: df.withColumn("nth", F.row_number().over(Window.partitionBy(F.lower(key)).orderBy(*order))).where("nth = 1").drop("nth")
    return areas.drop("w"), one(aliases, "alias", "name"), one(boroughs, "key", "ord"), asked


def area_resolve(spark, sf):
    """Queries by borough, alias, name, part of a name and part of a parent's name."""
    areas, aliases, boroughs, asked = _area_tables(spark, sf)
    found = names.resolve(asked, areas, aliases, boroughs)
    return asked.select("id").join(found, "id", "left").select("id", "branch", "code", "n_hits")


def area_in_text(spark, sf):
    """The area that each document names first, and by which rule."""
    areas, aliases, boroughs, _ = _area_tables(spark, sf)
    return names.in_texts(load(spark, sf, "documents"), areas, aliases, boroughs)


def _area_sql() -> tuple[str, str]:
    words = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: true)"
    one_based = lambda q: re.sub(r"w\[(\d)\]", lambda m: f"w[{int(m[1]) + 1}]", q)
    normal = lambda c: f"regexp_replace(lower({c}), '[^a-z]+', '', 'g')"
    hits = lambda key, where: f"SELECT {key} AS k, min(code) AS code, count(*) AS n FROM a WHERE {where} GROUP BY k"
    base = f"""
WITH a AS ({one_based(_AREAS.format(words=words, table="benchmark"))}),
l AS (SELECT lower(alias) AS low, name FROM ({one_based(_ALIASES.format(areas="a"))}) QUALIFY row_number() OVER (PARTITION BY lower(alias) ORDER BY name) = 1),
b AS (SELECT lower(key) AS low, borough, ord FROM ({one_based(_BOROUGHS.format(areas="a"))}) QUALIFY row_number() OVER (PARTITION BY lower(key) ORDER BY ord) = 1),
hb AS ({hits("borough", "true")}), hn AS ({hits("name", "true")}), hl AS ({hits("lower(name)", "true")}), hp AS ({hits(normal("name"), normal("name") + " <> ''")}), hc AS ({hits(normal("parent"), normal("parent") + " <> ''")}),
q AS (SELECT DISTINCT lower(trim(query)) AS low FROM (%s) WHERE trim(query) <> ''),
r AS (
  SELECT low, 0 AS place, 'borough' AS branch, code, n FROM q JOIN b USING (low) JOIN hb ON hb.k = borough
  UNION ALL SELECT low, 1, 'alias', code, n FROM q JOIN l USING (low) JOIN hn ON hn.k = l.name
  UNION ALL SELECT low, 2, 'exact', code, n FROM q JOIN hl ON hl.k = low
  UNION ALL SELECT low, 3, 'part', first(code ORDER BY abs(length(k) - length({normal("low")})), code), sum(n) FROM q JOIN hp ON {normal("low")} <> '' AND contains(k, {normal("low")}) GROUP BY low
  UNION ALL SELECT low, 4, 'parent', first(code ORDER BY abs(length(k) - length({normal("low")})), code), sum(n) FROM q JOIN hc ON {normal("low")} <> '' AND contains(k, {normal("low")}) GROUP BY low),
f AS (SELECT low, branch, code, CAST(n AS BIGINT) AS n_hits FROM r QUALIFY row_number() OVER (PARTITION BY low ORDER BY place) = 1)"""
    asked = one_based(_QUERIED.format(areas="a"))
    resolve = f"{base.replace("%s", asked)} SELECT id, branch, f.code, n_hits FROM ({asked}) LEFT JOIN f ON low = lower(trim(query))"
    keys = "SELECT low AS query FROM b UNION SELECT low FROM l UNION SELECT lower(name) FROM a WHERE length(name) >= 4"
    at = "' ' || d.t || ' '"
    text = f"""{base.replace("%s", keys)},
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
n AS (SELECT DISTINCT lower(name) AS low FROM a WHERE length(name) >= 4),
m AS (
  SELECT doc_id, low, 0 AS rule, ord AS o FROM d JOIN b ON contains({at}, ' ' || low || ' ')
  UNION ALL SELECT doc_id, low, 1, -length(low) FROM d JOIN l ON contains(t, low)
  UNION ALL SELECT doc_id, low, 2, -length(low) FROM d JOIN n ON contains({at}, ' ' || low || ' ') OR contains({at}, ' ' || low || '.') OR contains({at}, ' ' || low || ',') OR contains({at}, ' ' || low || '?')
  UNION ALL SELECT doc_id, low, 3, -length(low) FROM d JOIN n ON contains(t, low)),
p AS (SELECT m.*, code, n_hits FROM m JOIN f ON f.low = trim(m.low) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule, o, m.low) = 1)
SELECT doc_id, low AS key, rule, code, n_hits FROM p"""
    return resolve, text


_RESOLVE, _IN_TEXT = _area_sql()

QUERIES = {"area_resolve": (area_resolve, _RESOLVE), "area_in_text": (area_in_text, _IN_TEXT), "place_lookup": (place_lookup, _lookup_sql()), "vector_index_topk": (vector_index_topk, None), "vector_index_audit": (vector_index_audit, AUDIT)}
