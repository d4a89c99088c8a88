"""Queries on records and scenes: filters by list, keyword and age, identifiers, scene choice, tiles, narratives and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, quantiles, spatial
from .tables import load

#: Queries take the day they are asked on as a parameter, never the clock.
ASOF = "2001-06-30"


def descriptor_filter(spark, sf):
    """Records of two descriptors from the three years (of 365 days) before a day, newest first, 1000 at most."""
    o = load(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    recent = o.where(F.to_date("o_orderdate").between(F.date_sub(F.lit(ASOF).cast("date"), 3 * 365), F.lit(ASOF).cast("date")))
    return recent.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1000).select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


DESCRIPTORS = f"""
SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
AND CAST(o_orderdate AS DATE) BETWEEN DATE '{ASOF}' - 1095 AND DATE '{ASOF}' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000"""
KEYWORDS = ["cl", "pur", "err"]


def keyword_filter(spark, sf):
    """Events whose type contains a keyword, whatever its case, by type."""
    hit = F.exists(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.lower("event_type").contains(k))
    return load(spark, sf, "events").where(hit).groupBy("event_type").agg(F.count("*").alias("n"))


KEYWORD = f"SELECT event_type, count(*) AS n FROM events WHERE {' OR '.join(f'contains(lower(event_type), {chr(39)}{k}{chr(39)})' for k in KEYWORDS)} GROUP BY ALL"


def sensor_events_semi(spark, sf):
    """The 200 latest flood events of sensors that have purchases."""
    e = load(spark, sf, "events")
    known = e.where("event_type = 'purchase'").select("user_id").distinct()
    return e.where("event_type = 'error'").join(known, "user_id", "left_semi").orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id", "value")


SEMI = "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') ORDER BY ts DESC, event_id LIMIT 200"


def latest_per_station(spark, sf):
    """The last observed and the last predicted value of each station, and their difference."""
    e = load(spark, sf, "events")
    last = lambda k: F.max_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, F.struct("ts", "event_id")))
    return e.groupBy("user_id").agg(last("click").alias("observed"), last("view").alias("predicted")).withColumn("residual", F.round(F.col("observed") - F.col("predicted"), 4))


LATEST = "SELECT *, round(observed - predicted, 4) AS residual FROM (SELECT user_id, last(value ORDER BY ts, event_id) FILTER (event_type = 'click') AS observed, last(value ORDER BY ts, event_id) FILTER (event_type = 'view') AS predicted FROM events GROUP BY user_id)"


def chunked_union(spark, sf):
    """Series read in chunks of days and put together again, with each row once."""
    e = load(spark, sf, "events")
    chunk = lambda a, b: e.where(f"day(ts) BETWEEN {a} AND {b}").select("event_id", "event_type")
    whole = chunk(1, 10).unionByName(chunk(10, 20)).unionByName(chunk(20, 31)).dropDuplicates(["event_id"])
    return whole.groupBy("event_type").agg(F.count("*").alias("n"))


CHUNKS = "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type"


def _scenes(spark, sf):
    return load(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("place"), (F.col("p_size") * 2).cast("long").alias("cloud"), (F.col("p_partkey") * 7 % 60).alias("age"))


_SCENES = "(SELECT p_partkey, p_partkey % 40 AS place, CAST(p_size * 2 AS BIGINT) AS cloud, p_partkey * 7 % 60 AS age FROM part)"


def scene_selection(spark, sf):
    """Of each place the clearest scene under 60 % cloud, the youngest of equals."""
    best = spatial.top_n(_scenes(spark, sf).where("cloud < 60"), ["place"], [F.col("cloud"), F.col("age"), F.col("p_partkey")], 1)
    return best.select("place", "p_partkey", "cloud", "age")


SCENES = f"SELECT place, p_partkey, cloud, age FROM {_SCENES} WHERE cloud < 60 QUALIFY row_number() OVER (PARTITION BY place ORDER BY cloud, age, p_partkey) = 1"


def trigger_ladder(spark, sf):
    """The rung each place reaches: clear and recent, tolerant, or fallback."""
    s = _scenes(spark, sf).groupBy("place").agg(F.bool_or(F.expr("cloud < 30 AND age <= 3")).alias("a"), F.bool_or(F.expr("cloud < 50 AND age <= 14")).alias("b"))
    return s.select("place", F.when(F.col("a"), "clear").when(F.col("b"), "tolerant").otherwise("fallback").alias("rung"))


LADDER = f"SELECT place, CASE WHEN bool_or(cloud < 30 AND age <= 3) THEN 'clear' WHEN bool_or(cloud < 50 AND age <= 14) THEN 'tolerant' ELSE 'fallback' END AS rung FROM {_SCENES} GROUP BY place"


def static_table(spark, sf):
    """What a fixed table of rises (by year and percentile, inches to metres) says for each place's scenario."""
    rows = [(y, p, float(i)) for y, row in ((2050, (8, 16, 21, 30)), (2100, (15, 36, 50, 75))) for p, i in zip((10, 50, 90, 99), row)]
    rises = spark.createDataFrame(rows, "year long, percentile long, inches double").withColumn("metres", F.round(F.col("inches") * 0.0254, 3))
    places = load(spark, sf, "customer").selectExpr("c_custkey AS id", "CAST(2050 + 50 * (c_custkey % 2) AS BIGINT) AS year", "CAST(element_at(array(10, 50, 90, 99), CAST(c_nationkey % 4 AS INT) + 1) AS BIGINT) AS percentile")
    return places.join(F.broadcast(rises), ["year", "percentile"]).select("id", "year", "percentile", "inches", "metres")


_STATIC = ", ".join(f"({y}, {p}, {i})" for y, row in ((2050, (8, 16, 21, 30)), (2100, (15, 36, 50, 75))) for p, i in zip((10, 50, 90, 99), row))
STATIC = f"""
SELECT c_custkey AS id, CAST(y AS BIGINT) AS year, CAST(p AS BIGINT) AS percentile, CAST(i AS DOUBLE) AS inches, round(i * CAST(0.0254 AS DOUBLE), 3) AS metres
FROM customer JOIN (VALUES {_STATIC}) v(y, p, i) ON y = 2050 + 50 * (c_custkey % 2) AND p = [10, 50, 90, 99][c_nationkey % 4 + 1]"""


def identifiers(spark, sf):
    """Addresses from parts, padded lot identifiers (null where a part is missing), and integers that came as decimals."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 6).cast("string").alias("boro"), F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("00"), (F.col("c_custkey") % 900).cast("string"))).alias("block"), F.concat((F.col("c_custkey") % 70).cast("string"), F.lit(".0")).alias("lot"), F.lower("c_name").alias("street"))
    lot = F.regexp_replace("lot", r"\.0$", "")
    strip = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    ok = (F.col("boro") != "0") & F.col("block").isNotNull()
    bbl = F.when(ok, F.concat(F.col("boro"), F.lit("-"), F.lpad(strip(F.col("block")), 5, "0"), F.lit("-"), F.lpad(strip(lot), 4, "0")))
    return c.select("id", bbl.alias("bbl"), F.concat_ws(" ", F.nullif(lot, F.lit("0")), F.initcap("street")).alias("address"))


IDENTIFIERS = r"""
SELECT id, CASE WHEN boro <> '0' AND block IS NOT NULL THEN boro || '-' || lpad(CAST(block AS VARCHAR), 5, '0') || '-' || lpad(CAST(lot AS VARCHAR), 4, '0') END AS bbl,
  concat_ws(' ', CASE WHEN lot <> 0 THEN CAST(lot AS VARCHAR) END, upper(left(street, 1)) || substr(street, 2)) AS address
FROM (SELECT c_custkey AS id, CAST(c_custkey % 6 AS VARCHAR) AS boro, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 900 END AS block, c_custkey % 70 AS lot, lower(c_name) AS street FROM customer)"""


def percentile_stretch(spark, sf):
    """Prices of each brand stretched between their 2nd and 98th percentiles to 0..255."""
    p = load(spark, sf, "part")
    bounds = quantiles.quantiles(p, "p_brand", "p_retailprice", {"a": 0.02, "b": 0.98})
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p_retailprice") - F.col("a")) / (F.col("b") - F.col("a")))) * 255
    return p.join(bounds, "p_brand").groupBy("p_brand").agg(F.round(F.avg(scaled), 4).alias("mean"), F.count_if(scaled >= 255).alias("full"), F.count_if(scaled <= 0).alias("empty"))


STRETCH = """
WITH b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.02) AS a, quantile_cont(p_retailprice, 0.98) AS b FROM part GROUP BY p_brand),
s AS (SELECT p_brand, greatest(0, least(1, (p_retailprice - a) / (b - a))) * 255 AS s FROM part JOIN b USING (p_brand))
SELECT p_brand, round(avg(s), 4) AS mean, count(*) FILTER (s >= 255) AS full, count(*) FILTER (s <= 0) AS empty FROM s GROUP BY p_brand"""


def row_checksum(spark, sf):
    """SHA-256 over the joined fields of each supplier."""
    return load(spark, sf, "supplier").select("s_suppkey", F.sha2(F.concat_ws("_", "s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")), 256).alias("checksum"))


CHECKSUM = "SELECT s_suppkey, sha256(s_name || '_' || s_nationkey || '_' || s_suppkey) AS checksum FROM supplier"


def overlapping_fragments(spark, sf):
    """Fragments of 64 cells with 16 of overlap over a raster (orders, 112 in a row): their corners, and the wet share of each."""
    cells = load(spark, sf, "orders").selectExpr("o_orderkey DIV 112 AS row", "o_orderkey % 112 AS col", "CAST(o_custkey % 10 < 3 AS INT) AS wet")
    height = (cells.agg(F.max("row")).first()[0] or 0) + 1
    lowest = lambda c: F.greatest(F.lit(0).cast("long"), F.ceil((F.col(c) - 63) / 48))
    highest = lambda c, n: F.least(F.floor(F.col(c) / 48), F.lit((n - 64) // 48).cast("long"))
    span = lambda c, n: F.when(lowest(c) <= highest(c, n), F.sequence(lowest(c), highest(c, n)))
    dealt = cells.select("wet", F.explode(span("row", height)).alias("i"), "col").select("wet", "i", F.explode(span("col", 112)).alias("j"))
    return dealt.groupBy((F.col("i") * 48).alias("top"), (F.col("j") * 48).alias("left")).agg(F.count("*").alias("n"), F.round(F.avg("wet"), 6).alias("wet"))


FRAGMENTS = """
WITH c AS (SELECT o_orderkey // 112 AS r, o_orderkey % 112 AS c, CASE WHEN o_custkey % 10 < 3 THEN 1 ELSE 0 END AS wet FROM orders),
i AS (SELECT unnest(range((SELECT max(r) FROM c) // 48 + 1)) AS i), j AS (SELECT unnest(range(3)) AS j)
SELECT i * 48 AS top, j * 48 AS "left", count(*) AS n, round(avg(wet), 6) AS wet FROM i, j, c WHERE r BETWEEN i * 48 AND i * 48 + 63 AND c BETWEEN j * 48 AND j * 48 + 63 AND i * 48 + 64 <= (SELECT max(r) + 1 FROM c) AND j * 48 + 64 <= 112 GROUP BY ALL"""


def paragraph_split(spark, sf):
    """Paragraphs of the pages' text (between tags of blocks), white space collapsed, of 200 characters or more: how many, and how long."""
    text = F.regexp_replace("html", r"(?i)</?(p|div|h[1-6]|li|ul|table|tr|body|html|head)[^>]*>", "\n\n")
    parts = F.transform(F.split(F.regexp_replace(text, "<[^>]*>", ""), r"\n[ \t]*\n", -1), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " ")))
    kept = F.filter(parts, lambda p: F.length(p) >= 200)
    return load(spark, sf, "pages").select("page_id", F.size(kept).cast("long").alias("n"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, p: a + F.length(p)).alias("characters"))


PARAGRAPHS = r"""
SELECT page_id, len(k) AS n, CAST(coalesce(list_sum(list_transform(k, lambda p: length(p))), 0) AS BIGINT) AS characters FROM (
  SELECT page_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '(?i)</?(p|div|h[1-6]|li|ul|table|tr|body|html|head)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '\n[ \t]*\n'),
    lambda p: trim(regexp_replace(p, '[ \t\r\n]+', ' ', 'g'))), lambda p: length(p) >= 200) AS k FROM pages)"""


def rasterised_polygons(spark, sf):
    """Boxes burnt into a grid of 0.01 degrees, the highest class winning: cells of each class."""
    from .tables import boxes

    at = lambda c: F.floor(F.col(c) / 0.01).cast("long")
    b = boxes(load(spark, sf, "part"))
    cells = b.withColumn("row", F.explode(F.sequence(at("min_lat"), at("max_lat")))).withColumn("col", F.explode(F.sequence(at("min_lon"), at("max_lon"))))
    return cells.groupBy("row", "col").agg(F.max("class").alias("class")).groupBy("class").agg(F.count("*").alias("cells"))


def _raster_sql() -> str:
    from .tables import BOXES_SQL

    span = lambda c, n: f"unnest(generate_series(CAST(floor(({c} - half) / CAST(0.01 AS DOUBLE)) AS BIGINT), CAST(floor(({c} + half) / CAST(0.01 AS DOUBLE)) AS BIGINT))) AS {n}"
    return f"SELECT class, count(*) AS cells FROM (SELECT row, col, max(class) AS class FROM (SELECT row, class, {span('lon', 'col')} FROM (SELECT *, {span('lat', 'row')} FROM {BOXES_SQL})) GROUP BY row, col) GROUP BY class"


def audit_summary(spark, sf):
    """Runs (conversations) by outcome: all, those that end with an answer, those with dropped turns (short ones), and their share."""
    c = load(spark, sf, "conversations")
    runs = c.groupBy("conv_id").agg((F.max_by("role", "turn") == "assistant").alias("ok"), F.count_if(F.length("text") < 20).alias("dropped"), F.count("*").alias("turns"))
    return runs.groupBy("ok").agg(F.count("*").alias("runs"), F.count_if(F.col("dropped") > 0).alias("with_drops"), F.sum("dropped").alias("dropped"), F.sum("turns").alias("turns"))


AUDIT = """
SELECT ok, count(*) AS runs, count(*) FILTER (d > 0) AS with_drops, CAST(sum(d) AS BIGINT) AS dropped, CAST(sum(t) AS BIGINT) AS turns FROM (
  SELECT conv_id, last(role ORDER BY turn) = 'assistant' AS ok, count(*) FILTER (length(text) < 20) AS d, count(*) AS t FROM conversations GROUP BY conv_id) GROUP BY ok"""


def adversarial_pairs(spark, sf):
    """Templates paired with places in turn, by position, without a cross join."""
    templates = spark.createDataFrame([(i, t) for i, t in enumerate(["flood at {}", "is {} safe", "story on {}"])], "k long, template string")
    places = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"), "n_name")
    return places.withColumn("k", F.col("i") % 3).join(F.broadcast(templates), "k").select("i", F.replace("template", F.lit("{}"), F.col("n_name")).alias("query"))


PAIRS = "SELECT CAST(n_nationkey AS BIGINT) AS i, replace(['flood at {}', 'is {} safe', 'story on {}'][n_nationkey % 3 + 1], '{}', n_name) AS query FROM nation"


def alert_narrative(spark, sf):
    """A line on the alerts of each user's last day: none, the one, or the first three of n."""
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    users = e.groupBy("user_id").agg(F.max("day").alias("day"))
    kinds = e.where("event_type <> 'view'").join(users, ["user_id", "day"]).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("a"))
    names = F.transform("a", lambda x: x.event_type)
    line = F.when(F.col("a").isNull(), "no alert").when(F.size("a") == 1, F.concat(F.lit("alert: "), F.get(names, F.lit(0)))).otherwise(F.concat(F.size("a").cast("string"), F.lit(" alerts: "), F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size("a") > 3, ", ...").otherwise("")))
    return users.join(kinds, "user_id", "left").select("user_id", line.alias("line"))


ALERTS = """
WITH d AS (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY user_id),
k AS (SELECT user_id, list(event_type ORDER BY event_id) AS a FROM events JOIN d USING (user_id) WHERE event_type <> 'view' AND CAST(ts AS DATE) = d GROUP BY user_id)
SELECT user_id, CASE WHEN a IS NULL THEN 'no alert' WHEN len(a) = 1 THEN 'alert: ' || a[1] ELSE len(a) || ' alerts: ' || array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ', ...' ELSE '' END END AS line
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN k USING (user_id)"""


def first_seen_citations(spark, sf):
    """The first event of each type by user, in order of first occurrence."""
    first = aggregates.first_seen(load(spark, sf, "events"), ["user_id", "event_type"], F.col("event_id"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x.event_type), ">").alias("types"))


FIRST_SEEN = "SELECT user_id, string_agg(event_type, '>' ORDER BY e) AS types FROM (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY ALL) GROUP BY user_id"


def written_union(spark, sf):
    """Fields each region writes, against all fields written anywhere: those it leaves null."""
    n = load(spark, sf, "supplier").join(load(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey").select(F.col("n_regionkey").cast("long").alias("region"), (F.col("s_suppkey") % 9).alias("field")).distinct()
    every = n.select("region").distinct().join(F.broadcast(n.select("field").distinct().groupBy().agg(F.collect_list("field").alias("all"))))
    mine = n.groupBy("region").agg(F.collect_list("field").alias("mine"))
    return every.join(mine, "region").select("region", F.array_join(F.array_sort(F.array_except("all", "mine")), ",").alias("missing"))


WRITTEN = """
WITH n AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS region, s_suppkey % 9 AS field FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT r.region, coalesce(string_agg(CAST(f.field AS VARCHAR), ',' ORDER BY f.field) FILTER (n.field IS NULL), '') AS missing FROM (SELECT DISTINCT region FROM n) r CROSS JOIN (SELECT DISTINCT field FROM n) f LEFT JOIN n ON n.region = r.region AND n.field = f.field GROUP BY r.region"""


def ordered_window(spark, sf):
    """Severity ranking: three times the storm flag plus the depth class, highest first, in order of key; the first eight of each segment."""
    c = load(spark, sf, "customer").withColumn("severity", (F.col("c_acctbal") < 0).cast("long") * 3 + F.col("c_custkey") % 4)
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("severity"), "c_custkey")
    return c.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 8").select("c_mktsegment", "c_custkey", "severity", "rank")


SEVERITY = "SELECT c_mktsegment, c_custkey, CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END + c_custkey % 4 AS severity, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END + c_custkey % 4 DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 8"

QUERIES = {
    "descriptor_filter": (descriptor_filter, DESCRIPTORS), "keyword_filter": (keyword_filter, KEYWORD), "sensor_events_semi": (sensor_events_semi, SEMI), "latest_per_station": (latest_per_station, LATEST),
    "chunked_union": (chunked_union, CHUNKS), "scene_selection": (scene_selection, SCENES), "trigger_ladder": (trigger_ladder, LADDER), "static_table": (static_table, STATIC), "identifiers": (identifiers, IDENTIFIERS),
    "percentile_stretch": (percentile_stretch, STRETCH), "row_checksum": (row_checksum, CHECKSUM), "overlapping_fragments": (overlapping_fragments, FRAGMENTS), "paragraph_split": (paragraph_split, PARAGRAPHS),
    "rasterised_polygons": (rasterised_polygons, _raster_sql()), "audit_summary": (audit_summary, AUDIT), "adversarial_pairs": (adversarial_pairs, PAIRS), "alert_narrative": (alert_narrative, ALERTS),
    "first_seen_citations": (first_seen_citations, FIRST_SEEN), "written_union": (written_union, WRITTEN), "severity_ranking": (ordered_window, SEVERITY),
}
