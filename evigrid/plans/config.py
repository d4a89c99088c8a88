"""Queries on the configuration of sources, JSON paths, templated briefings and payload hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import manifests, sinks
from ..sources.manifests import Manifest
from .tables import load

BASE = [
    Manifest("storm_extent", "Storm extent", "baked", "hazard", "polygons", "empirical", "storm", None, 2), Manifest("marks", "High-water marks", "baked", "hazard", "points", "empirical", "hwm", None, 1),
    Manifest("gauges", "Stream gauges", "live", "live", "call", "empirical", "gauge"), Manifest("forecast", "Surge forecast", "model", "outlook", "call", "modeled", None, None, 3),
]
FEDERAL = [Manifest("gauges", "National gauges", "live", "live", "call", "empirical", "gauge_us", "us_conus"), Manifest("alerts", "Weather alerts", "live", "outlook", "call", "modeled", "alerts", "us_conus", 1)]
USER = [Manifest("firehouses", "Firehouses", "baked", "assets", "csv", None, "fire", None, 1), Manifest("marks", "Own marks", "baked", "hazard", "points", "empirical", "own")]
ROLES = [("hazard", 1), ("assets", 2), ("live", 3), ("outlook", 4)]


def _table(spark):
    return manifests.table(spark, {"base": BASE, "federal": FEDERAL, "user": USER})


#: Manifests of the tables: a nation is a source of the base layer, a supplier of some nations one of the federal layer, a customer one of the user's.
_LAYERED = """
SELECT 'base' AS layer, 0 AS rank, CAST(n_nationkey AS BIGINT) AS ord, concat('src_', CAST(n_nationkey AS STRING)) AS id, n_name AS title, CASE WHEN n_regionkey % 2 = 0 THEN 'hazard' ELSE 'live' END AS role,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('doc_', CAST(n_nationkey AS STRING)) END AS doc_id, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS BIGINT) END AS place FROM nation
UNION ALL SELECT 'federal', 1, s_suppkey, concat('src_', CAST(s_suppkey % 40 AS STRING)), s_name, 'outlook', CAST(NULL AS STRING), s_suppkey % 5 FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'user', 2, c_custkey, concat('src_', CAST(c_custkey % 900 AS STRING)), c_name, 'assets', concat('own_', CAST(c_custkey % 7 AS STRING)), CAST(NULL AS BIGINT) FROM customer WHERE c_custkey % 7 = 1"""


def _layered(spark, sf):
    for name in ("nation", "supplier", "customer"):
        load(spark, sf, name).createOrReplaceTempView(f"manifest_{name}")
    text = _LAYERED
    for name in ("nation", "supplier", "customer"):
        text = text.replace(f"FROM {name}", f"FROM manifest_{name}")
    return spark.sql(text).withColumnRenamed("place", "order")


def manifest_precedence(spark, sf):
    """The source that holds for each id, of three layers of manifests."""
    return manifests.merged(_layered(spark, sf)).select("id", "layer", "title", "doc_id")


_MERGED_LAYERS = f"(SELECT * FROM ({_LAYERED.replace('AS STRING', 'AS VARCHAR')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC, ord) = 1)"
PRECEDENCE = f"SELECT id, layer, title, doc_id FROM {_MERGED_LAYERS}"


def describe_sources(spark, sf):
    """The merged sources in the order of their roles."""
    return manifests.described(manifests.merged(_layered(spark, sf)), spark.createDataFrame(ROLES, "role string, role_order int"))


DESCRIBE = f"SELECT row_number() OVER (ORDER BY o, coalesce(place, 999), id) AS place, role, id, title, coalesce(doc_id, id) AS doc_id FROM {_MERGED_LAYERS} JOIN (VALUES {', '.join(map(str, ROLES))}) r(role, o) USING (role)"


_ROWS = ", ".join(
    f"('{layer}', {manifests.LAYERS[layer]}, {i}, '{m.id}', '{m.title}', '{m.role}', {repr(m.doc_id) if m.doc_id else 'NULL'}, {m.order if m.order is not None else 'NULL'})"
    for layer, ms in (("base", BASE), ("federal", FEDERAL), ("user", USER)) for i, m in enumerate(ms)
)
_MERGED = f"(SELECT * FROM (VALUES {_ROWS}) m(layer, rank, ord, id, title, role, doc_id, place) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC, ord) = 1)"


def plan_trim(spark, sf):
    """Documents kept by plans: those whose id begins with a planned prefix, and those always kept; all, where nothing matches."""
    plans = load(spark, sf, "nation").select(F.col("n_nationkey").alias("plan_id"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("ho"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("g"), F.lit("al"))).otherwise(F.array(F.lit("zz"))).alias("prefixes"))
    docs = manifests.merged(_table(spark)).select(F.coalesce("doc_id", "id").alias("doc"))
    wanted = docs.groupBy().agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    every = plans.join(F.broadcast(wanted))
    kept = F.filter("docs", lambda d: F.exists("prefixes", lambda p: d.startswith(p)))
    named = F.when(F.size(kept) == 0, F.col("docs")).otherwise(F.array_sort(F.array_union(kept, F.array(F.lit("storm")))))
    return every.select("plan_id", F.array_join(named, ",").alias("kept"))


PLAN_TRIM = f"""
WITH d AS (SELECT list_sort(list(coalesce(doc_id, id))) AS docs FROM {_MERGED}),
p AS (SELECT n_nationkey AS plan_id, CASE n_nationkey % 3 WHEN 0 THEN ['ho'] WHEN 1 THEN ['g', 'al'] ELSE ['zz'] END AS prefixes FROM nation),
k AS (SELECT plan_id, docs, list_filter(docs, lambda d: len(list_filter(prefixes, lambda p: starts_with(d, p))) > 0) AS kept FROM p, d)
SELECT plan_id, array_to_string(CASE WHEN len(kept) = 0 THEN docs ELSE list_sort(list_distinct(list_append(kept, 'storm'))) END, ',') AS kept FROM k"""


def json_path(spark, sf):
    """The value at a path of the events' JSON, summed by type; a missing path counts as none."""
    e = load(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.a.b[0]").alias("none"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("none").alias("found"))


JSON_PATH = "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.a.b[0]')) AS found FROM events GROUP BY event_type"


def briefing_templated(spark, sf):
    """Briefings from templates: a cited sentence for each finding, sections by role; a finding without a value falls back to a short form."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 40) / 4).alias("depth"), (F.col("c_custkey") % 7).alias("n"))
    depth = F.coalesce(F.concat(F.lit("Depth reached "), F.format_number("depth", 2), F.lit(" ft [hwm].")), F.lit("No depth is known [hwm]."))
    gauge = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " gauge is near [gauge].").otherwise(" gauges are near [gauge]."))
    return c.select("id", F.concat(F.lit("**Hazard**\n"), depth, F.lit("\n**Live**\n"), gauge).alias("text"))


TEMPLATED = r"""
SELECT c_custkey AS id, '**Hazard**' || chr(10) || CASE WHEN c_custkey % 5 <> 0 THEN 'Depth reached ' || printf('%.2f', CAST(c_custkey % 40 AS DOUBLE) / 4) || ' ft [hwm].' ELSE 'No depth is known [hwm].' END || chr(10) || '**Live**' || chr(10)
  || CAST(c_custkey % 7 AS VARCHAR) || CASE WHEN c_custkey % 7 = 1 THEN ' gauge is near [gauge].' ELSE ' gauges are near [gauge].' END AS text FROM customer"""


def payload_hash(spark, sf):
    """SHA-256 of each nation's payload with its keys in order."""
    return load(spark, sf, "nation").select("n_nationkey", sinks.payload_hash(["n_name", "n_nationkey", "n_regionkey"]).alias("sha256"))


PAYLOAD = """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS sha256 FROM nation"""

QUERIES = {
    "manifest_precedence": (manifest_precedence, PRECEDENCE), "describe_sources": (describe_sources, DESCRIBE), "plan_trim": (plan_trim, PLAN_TRIM), "json_path": (json_path, JSON_PATH),
    "briefing_templated": (briefing_templated, TEMPLATED), "payload_hash": (payload_hash, PAYLOAD),
}
