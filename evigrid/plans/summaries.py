"""Queries that summarise records: counts, histograms, latest rows, rates, zones, ledgers and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, quantiles
from .tables import load


def top_counts(spark, sf):
    """The five most frequent priorities of each order status."""
    return aggregates.top_counts(load(spark, sf, "orders"), ["o_orderstatus"], F.col("o_orderpriority"), F.col("o_orderkey"), 5).select("o_orderstatus", "value", "n", "rank")


TOP_COUNTS = """
SELECT o_orderstatus, value, n, rank FROM (
  SELECT o_orderstatus, coalesce(nullif(trim(o_orderpriority), ''), '?') AS value, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, min(o_orderkey)) AS rank
  FROM orders GROUP BY o_orderstatus, coalesce(nullif(trim(o_orderpriority), ''), '?')) WHERE rank <= 5"""


def yearly_histogram(spark, sf):
    """Records of each year by descriptor, with the total of the year."""
    orders = load(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority")
    counted = orders.groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"))
    return counted.withColumn("n_year", F.sum("n").over(Window.partitionBy("year")))


YEARLY = "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY year(o_orderdate)) AS BIGINT) AS n_year FROM orders GROUP BY year(o_orderdate), o_orderpriority"


def recent_records(spark, sf):
    """The five latest orders of each customer segment."""
    named = load(spark, sf, "orders").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").select("c_mktsegment", "rank", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


RECENT = """
SELECT c_mktsegment, rank, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (
  SELECT c_mktsegment, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rank <= 5"""


def dedupe_latest(spark, sf):
    """The latest shipment of each order, the first line on ties."""
    items = load(spark, sf, "lineitem")
    return aggregates.latest(items, ["l_orderkey"], F.col("l_shipdate"), F.struct("l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


DEDUPE = """
SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) = 1"""


def permit_rollup(spark, sf):
    """Jobs by flag and status: totals, exposed ones, severe ones, any; with a chained lookup of flags by part and supplier."""
    jobs = aggregates.latest(load(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_shipdate"), F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    flags = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 4).alias("depth"))
    storm = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("storm"))
    joined = jobs.join(flags, "l_partkey", "left").join(storm, "l_suppkey", "left")
    depth, hit = F.coalesce("depth", F.lit(0)), F.coalesce("storm", F.lit(False))
    counts = [F.count("*").alias("n_total"), F.count_if(hit).alias("n_storm"), F.count_if(depth > 0).alias("n_depth"), F.count_if(depth >= 2).alias("n_severe"), F.count_if(hit | (depth > 0)).alias("n_any")]
    return joined.groupBy("l_returnflag", "l_linestatus").agg(*counts)


PERMITS = """
SELECT l_returnflag, l_linestatus, count(*) AS n_total, count(*) FILTER (s_acctbal < 0) AS n_storm, count(*) FILTER (p_size % 4 > 0) AS n_depth, count(*) FILTER (p_size % 4 >= 2) AS n_severe,
  count(*) FILTER (coalesce(s_acctbal < 0, false) OR coalesce(p_size % 4 > 0, false)) AS n_any FROM (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) = 1)
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"""


def sensor_summary(spark, sf):
    """Per sensor: all events, flood events, the deepest flood (the first on ties)."""
    events = load(spark, sf, "events")
    flood = F.col("event_type") == "error"
    rolled = events.groupBy("user_id").agg(F.count("*").alias("n_all"), F.count_if(flood).alias("n_flood"), F.max_by(F.when(flood, F.struct("value", "event_id")), F.when(flood, F.struct(F.col("value"), -F.col("event_id")))).alias("p"))
    return rolled.select("user_id", "n_all", "n_flood", F.coalesce("p.value", F.lit(0.0)).alias("peak"), F.col("p.event_id").alias("peak_event"))


SENSORS = """
SELECT user_id, count(*) AS n_all, count(*) FILTER (event_type = 'error') AS n_flood, coalesce(max(value) FILTER (event_type = 'error'), 0) AS peak,
  first(event_id ORDER BY value DESC, event_id) FILTER (event_type = 'error') AS peak_event FROM events GROUP BY user_id"""


def sensor_totals(spark, sf):
    """Sensors, flood events, sensors with floods, and the deepest flood of all."""
    e = load(spark, sf, "events").where("event_type = 'error'")
    return e.agg(F.count_distinct("user_id").alias("n_sensors"), F.count("*").alias("n_events"), F.max("value").alias("peak"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("peak_event"))


SENSOR_TOTALS = "SELECT count(DISTINCT user_id) AS n_sensors, count(*) AS n_events, max(value) AS peak, first(event_id ORDER BY value DESC, event_id) AS peak_event FROM events WHERE event_type = 'error'"


def site_pivot(spark, sf):
    """The last value of each event type, one column each, of users who have viewed."""
    kinds = ["view", "click", "purchase"]
    wide = load(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.max_by("value", F.struct("ts", "event_id")))
    return wide.where("view IS NOT NULL").select("user_id", *[F.col(k).alias(f"last_{k}") for k in kinds])


PIVOT = "SELECT user_id, " + ", ".join(f"last(value ORDER BY ts, event_id) FILTER (event_type = '{k}') AS last_{k}" for k in ("view", "click", "purchase")) + " FROM events GROUP BY user_id HAVING last_view IS NOT NULL"


def zonal_stats(spark, sf):
    """Statistics of the raster values (prices) of each zone (brand), and the share of low ones."""
    part = load(spark, sf, "part")
    plain = part.groupBy("p_brand").agg(*aggregates.zonal_plain("p_retailprice"), F.avg((F.col("p_size") < 10).cast("double")).alias("low"))
    places = quantiles.quantiles(part, "p_brand", "p_retailprice", {"median": 0.5, "p10": 0.1, "p90": 0.9}).withColumnRenamed("p_brand", "zone")
    stats = plain.join(places, F.col("p_brand").eqNullSafe(F.col("zone")))
    return stats.select("p_brand", "n", "min", *[F.round(c, 4).alias(c) for c in ("median", "p10", "p90")], "max", F.round("low", 6).alias("low"))


ZONAL = """
SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.1), 4) AS p10,
  round(quantile_cont(p_retailprice, 0.9), 4) AS p90, max(p_retailprice) AS max, round(avg(CASE WHEN p_size < 10 THEN 1.0 ELSE 0.0 END), 6) AS low FROM part GROUP BY p_brand"""


def class_fractions(spark, sf):
    """The share of each size class within each brand, and the dominant class."""
    cells = load(spark, sf, "part").select("p_brand", (F.col("p_size") % 5).cast("long").alias("class"))
    return aggregates.fractions(cells, ["p_brand"], "class").select("p_brand", "class", "n", F.round("fraction", 6).alias("fraction"), "dominant")


FRACTIONS = """
SELECT p_brand, CAST(p_size % 5 AS BIGINT) AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS fraction,
  row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size % 5) = 1 AS dominant FROM part GROUP BY p_brand, p_size % 5"""


def window_percentile(spark, sf):
    """Of each raster cell: the share of cells in the 11 x 11 square around it with a strictly smaller value, by shifts of the grid (customers, 40 in a row)."""
    grid = load(spark, sf, "customer").selectExpr("c_custkey DIV 40 AS row", "c_custkey % 40 AS col", "c_acctbal AS v")
    offsets = F.sequence(F.lit(-5), F.lit(5))
    around = grid.select("v", F.explode(F.transform(offsets, lambda d: F.col("row") + d)).alias("row"), "col").select("v", "row", F.explode(F.transform(offsets, lambda d: F.col("col") + d)).alias("col"))
    met = around.withColumnRenamed("v", "other").join(grid, ["row", "col"])
    return met.groupBy("row", "col").agg(F.round(F.count_if(F.col("other") < F.col("v")) * 100.0 / F.count("*"), 4).alias("percentile"))


WINDOW_PERCENTILE = """
WITH g AS (SELECT c_custkey // 40 AS row, c_custkey % 40 AS col, c_acctbal AS v FROM customer)
SELECT a.row, a.col, round(count(*) FILTER (b.v < a.v) * 100.0 / count(*), 4) AS percentile FROM g a JOIN g b ON abs(a.row - b.row) <= 5 AND abs(a.col - b.col) <= 5 GROUP BY ALL"""


def energy_ledger(spark, sf):
    """Energy by kind, by hardware and in all: W x s / 3600, tokens of zero as missing."""
    calls = load(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("long").alias("hardware"), (F.col("value") * 60 / 3600).alias("wh"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 100).alias("tokens"))
    grouped = calls.groupingSets([[], ["event_type"], ["hardware"]], "event_type", "hardware")
    return grouped.agg(F.count("*").alias("calls"), F.round(F.sum("wh"), 3).alias("wh"), F.sum("tokens").alias("tokens"))


LEDGER = """
SELECT event_type, hardware, count(*) AS calls, round(sum(value * 60 / 3600), 3) AS wh, CAST(sum(tokens) AS BIGINT) AS tokens
FROM (SELECT event_type, CAST(user_id % 3 AS BIGINT) AS hardware, value, CASE WHEN event_id % 7 <> 0 THEN event_id % 100 END AS tokens FROM events) GROUP BY GROUPING SETS ((), (event_type), (hardware))"""


def confusion_rates(spark, sf):
    """Of the labelled documents of each language: how often a rule (under 500 characters) flags low and good quality."""
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    flag = F.col("n_chars") < 500
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(aggregates.rate(flag, F.col("quality") == 0), 6).alias("hit_rate"), F.round(aggregates.rate(flag, F.col("quality") == 1), 6).alias("false_rate"))


CONFUSION = """
SELECT lang, count(*) AS n, round(count(*) FILTER (n_chars < 500 AND quality = 0) / greatest(count(*) FILTER (quality = 0), 1), 6) AS hit_rate,
  round(count(*) FILTER (n_chars < 500 AND quality = 1) / greatest(count(*) FILTER (quality = 1), 1), 6) AS false_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang"""


def run_delta(spark, sf):
    """Two runs (the two halves of the month) side by side: mean values by user, and what became of each user."""
    e = load(spark, sf, "events").where("event_type = 'purchase'")
    half = lambda c: e.where(c).groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("v"))
    out = aggregates.full_outer_delta(half("day(ts) <= 15"), half("day(ts) > 15"), "user_id", "v", 1.0)
    return out.withColumn("delta", F.round("delta", 6))


RUN_DELTA = """
WITH h AS (SELECT user_id, round(avg(value) FILTER (day(ts) <= 15), 9) AS before, round(avg(value) FILTER (day(ts) > 15), 9) AS after FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, before, after, round(after - before, 6) AS delta, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN after - before > 1 THEN 'up' WHEN after - before < -1 THEN 'down' ELSE 'same' END AS state FROM h"""


def compare_merge(spark, sf):
    """Checks of two runs of each user merged: what both passed, what either failed."""
    e = load(spark, sf, "events")
    kinds = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("event_type"))))
    sets = e.groupBy("user_id").agg(kinds(F.col("event_id") % 2 == 0).alias("a"), kinds(F.col("event_id") % 2 == 1).alias("b"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select("user_id", join(F.array_intersect("a", "b")).alias("both"), join(F.array_union("a", "b")).alias("either"), join(F.array_except("a", "b")).alias("first_only"))


_KINDS = lambda k: f"list_distinct(coalesce(list(event_type) FILTER (event_id % 2 = {k}), []))"
COMPARE = f"""
WITH s AS (SELECT user_id, {_KINDS(0)} AS a, {_KINDS(1)} AS b FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS "both", array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either,
  array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS first_only FROM s"""


def water_difference(spark, sf):
    """Cells wet after but not before an event, of two rasters; and the two-class accuracy of one as a forecast of the other."""
    grid = load(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey % 10 < 3 AS pre", "(o_orderkey * 7919 + o_custkey) % 10 < 4 AS post")
    pre = grid.select("id", "pre")
    both = pre.join(grid.select("id", "post"), "id")
    p, q = F.col("pre"), F.col("post")
    iou = lambda a, b: F.round(F.count_if(a & b) / F.count_if(a | b), 6)
    return both.agg(F.count_if(q & ~p).alias("new_cells"), iou(p, q).alias("iou_wet"), iou(~p, ~q).alias("iou_dry"))


WATER = """
WITH g AS (SELECT o_custkey % 10 < 3 AS pre, (o_orderkey * 7919 + o_custkey) % 10 < 4 AS post FROM orders)
SELECT count(*) FILTER (post AND NOT pre) AS new_cells, round(count(*) FILTER (pre AND post) / count(*) FILTER (pre OR post), 6) AS iou_wet, round(count(*) FILTER (NOT pre AND NOT post) / count(*) FILTER (NOT pre OR NOT post), 6) AS iou_dry FROM g"""


def circular_mean(spark, sf):
    """Share of wet cells within 12 cells of the centres of a raster's tiles of 50 x 50 cells."""
    grid = load(spark, sf, "orders").selectExpr("o_orderkey DIV 200 AS row", "o_orderkey % 200 AS col", "CAST(o_custkey % 10 < 3 AS INT) AS wet")
    tile = grid.selectExpr("row DIV 50 AS tile_row", "col DIV 50 AS tile_col", "row % 50 - 25 AS dy", "col % 50 - 25 AS dx", "wet")
    return tile.where("dx * dx + dy * dy <= 144").groupBy("tile_row", "tile_col").agg(F.round(F.avg("wet") * 100, 4).alias("wet_pct"), F.count("*").alias("n"))


CIRCULAR = """
WITH g AS (SELECT o_orderkey // 200 AS r, o_orderkey % 200 AS c, CASE WHEN o_custkey % 10 < 3 THEN 1 ELSE 0 END AS wet FROM orders)
SELECT r // 50 AS tile_row, c // 50 AS tile_col, round(avg(wet) * 100, 4) AS wet_pct, count(*) AS n FROM g WHERE pow(r % 50 - 25, 2) + pow(c % 50 - 25, 2) <= 144 GROUP BY ALL"""


def generic_cube(spark, sf):
    """Order totals by status and priority, with all subtotals."""
    return load(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


def set_operations(spark, sf):
    """Customers with orders, without any, and in the first segment but without orders; as counts."""
    c, o = load(spark, sf, "customer").select("c_custkey"), load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    first = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return n(c.intersect(o), "with").unionByName(n(c.exceptAll(o), "without")).unionByName(n(first.join(o, "c_custkey", "left_anti"), "first_without"))


SETS = """
SELECT 'with' AS what, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL
SELECT 'without', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'first_without', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders)"""

QUERIES = {
    "top_counts": (top_counts, TOP_COUNTS), "yearly_histogram": (yearly_histogram, YEARLY), "recent_records": (recent_records, RECENT), "dedupe_latest": (dedupe_latest, DEDUPE),
    "permit_rollup": (permit_rollup, PERMITS), "sensor_summary": (sensor_summary, SENSORS), "sensor_totals": (sensor_totals, SENSOR_TOTALS), "site_pivot": (site_pivot, PIVOT),
    "zonal_stats": (zonal_stats, ZONAL), "class_fractions": (class_fractions, FRACTIONS), "window_percentile": (window_percentile, WINDOW_PERCENTILE),
    "energy_ledger_grouping_sets": (energy_ledger, LEDGER), "confusion_rates": (confusion_rates, CONFUSION), "run_delta_full_outer": (run_delta, RUN_DELTA),
    "compare_merge": (compare_merge, COMPARE), "water_difference": (water_difference, WATER), "circular_mean": (circular_mean, CIRCULAR), "generic_cube": (generic_cube, CUBE), "set_operations": (set_operations, SETS),
}
