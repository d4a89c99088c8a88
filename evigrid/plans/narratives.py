"""Queries that turn findings into words, and small rules on places, names and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .tables import load
from .text import _QUESTION, _briefings, BRIEFINGS, questions

LABELS = {1: "nuisance", 2: "moderate", 3: "deep"}


def depth_labels(spark, sf):
    """Depth classes with their labels and the phrase for the storm zone; class 0 has none."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("depth"), (F.col("c_acctbal") < 0).alias("storm"))
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return c.select("id", F.try_element_at(names, F.col("depth").cast("int")).alias("label"), F.when(F.col("storm"), "inside the storm extent").otherwise("outside the storm extent").alias("phrase"))


DEPTHS = "SELECT c_custkey AS id, CASE c_custkey % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABELS.items()) + " END AS label, CASE WHEN c_acctbal < 0 THEN 'inside the storm extent' ELSE 'outside the storm extent' END AS phrase FROM customer"


def borough_detection(spark, sf):
    """The borough a question names, by name or hint; the longest name counts."""
    hints = {"red hook": "brooklyn", "gowanus": "brooklyn", "coney island": "brooklyn", "astoria": "queens", "queens": "queens", "harlem": "manhattan", "hunts point": "bronx", "broadway": "manhattan"}
    low = F.lower("query")
    found = F.coalesce(*[F.when(low.contains(h), F.lit(b)) for h, b in sorted(hints.items(), key=lambda x: -len(x[0]))], F.lit("none"))
    return questions(spark, sf).groupBy(found.alias("borough")).agg(F.count("*").alias("n"))


BOROUGH = f"""
SELECT CASE WHEN contains(lower(query), 'coney island') THEN 'brooklyn' WHEN contains(lower(query), 'hunts point') THEN 'bronx' WHEN contains(lower(query), 'red hook') THEN 'brooklyn' WHEN contains(lower(query), 'broadway') THEN 'manhattan'
  WHEN contains(lower(query), 'gowanus') THEN 'brooklyn' WHEN contains(lower(query), 'astoria') THEN 'queens' WHEN contains(lower(query), 'queens') THEN 'queens' WHEN contains(lower(query), 'harlem') THEN 'manhattan' ELSE 'none' END AS borough, count(*) AS n FROM {_QUESTION} GROUP BY ALL"""


def tide_narrative(spark, sf):
    """A line on each station's residual: above, below or at the prediction; none without both values."""
    e = load(spark, sf, "events")
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    r = e.groupBy("user_id").agg(F.round(mean("click") - mean("view"), 1).alias("r"))
    line = F.when(F.col("r").isNull(), "no reading").when(F.col("r") > 0.5, "above").when(F.col("r") < -0.5, "below").otherwise("as predicted")
    return r.groupBy(line.alias("line")).agg(F.count("*").alias("n"))


TIDE = """
SELECT CASE WHEN r IS NULL THEN 'no reading' WHEN r > 0.5 THEN 'above' WHEN r < -0.5 THEN 'below' ELSE 'as predicted' END AS line, count(*) AS n FROM (
  SELECT user_id, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 1) AS r FROM events GROUP BY user_id) GROUP BY ALL"""


def weather_narrative(spark, sf):
    """The first precipitation available of one, three and six hours (events of three kinds), on each user's last day."""
    every = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    e = every.join(every.groupBy("user_id").agg(F.max("day").alias("day")), ["user_id", "day"])
    wide = e.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("signup", "purchase", "view")])
    pick = lambda k, h: F.when(F.col(k).isNotNull(), F.concat(F.col(k).cast("string"), F.lit(f" mm in {h} h")))
    return wide.select("user_id", F.coalesce(pick("signup", 1), pick("purchase", 3), pick("view", 6), F.lit("no rain gauge")).alias("line"))


WEATHER = """
SELECT user_id, coalesce(CASE WHEN s IS NOT NULL THEN s || ' mm in 1 h' END, CASE WHEN p IS NOT NULL THEN p || ' mm in 3 h' END, CASE WHEN v IS NOT NULL THEN v || ' mm in 6 h' END, 'no rain gauge') AS line FROM (
  SELECT user_id, max(value) FILTER (event_type = 'signup') AS s, max(value) FILTER (event_type = 'purchase') AS p, max(value) FILTER (event_type = 'view') AS v FROM events JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY user_id) USING (user_id) WHERE CAST(ts AS DATE) = d GROUP BY user_id)"""


def framing_score(spark, sf):
    """Five points of a briefing's framing: a number first, a citation, a hedge, a place, no exclamation; their distribution."""
    t = F.lower("text")
    first = F.regexp_extract("text", r"^([^.!?]*[.!?])", 1)
    points = [first.rlike("[0-9]"), t.rlike(r"\[[a-z_]+\]"), t.rlike("may|could|modeled|probably"), t.rlike("zone|address|pit"), ~t.contains("!")]
    score = sum((p.cast("int") for p in points), F.lit(0))
    return _briefings(spark, sf).groupBy(score.cast("long").alias("score")).agg(F.count("*").alias("n"))


_POINTS = [r"regexp_matches(regexp_extract(text, '^([^.!?]*[.!?])', 1), '[0-9]')", r"regexp_matches(lower(text), '\[[a-z_]+\]')", "regexp_matches(lower(text), 'may|could|modeled|probably')", "regexp_matches(lower(text), 'zone|address|pit')", "NOT contains(lower(text), '!')"]
FRAMING_SCORE = f"SELECT CAST({' + '.join(f'CASE WHEN {p} THEN 1 ELSE 0 END' for p in _POINTS)} AS BIGINT) AS score, count(*) AS n FROM {BRIEFINGS} GROUP BY ALL"


def opening_sentence(spark, sf):
    """The opening sentence of each briefing, and the text wrapped with its scope when it has 50 characters or more."""
    opening = F.regexp_extract("text", r"^([^.!?]*[.!?])", 1)
    return _briefings(spark, sf).select("id", opening.alias("opening"), F.length(F.when(F.length("text") >= 50, F.concat(F.lit("Scope. "), F.col("text"), F.lit(" End."))).otherwise(F.col("text"))).cast("long").alias("wrapped"))


OPENING = f"SELECT id, regexp_extract(text, '^([^.!?]*[.!?])', 1) AS opening, CASE WHEN length(text) >= 50 THEN length(text) + 12 ELSE length(text) END AS wrapped FROM {BRIEFINGS}"


def token_estimate(spark, sf):
    """Tokens of each language's documents, estimated at four characters each, one at least."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_chars") / 4))
    return load(spark, sf, "documents").groupBy("lang").agg(F.sum(n).alias("tokens"), F.max(n).alias("longest"))


TOKENS = "SELECT lang, CAST(sum(greatest(1, n_chars // 4)) AS BIGINT) AS tokens, max(greatest(1, n_chars // 4)) AS longest FROM documents GROUP BY lang"


def bracketed_power(spark, sf):
    """Mean of the samples before and after each purchase, if they are under six hours away; null where both are stale."""
    e = load(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_timestamp("ts")
    near = lambda f: F.when(F.abs(f("s").over(order) - F.col("s")) <= 6 * 3600, f("value").over(order))
    x = e.withColumn("s", at).withColumn("a", near(F.lag)).withColumn("b", near(F.lead)).where("event_type = 'purchase'")
    both = F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b")
    return x.select("event_id", F.round(both, 6).alias("power"))


POWER = """
SELECT event_id, round(coalesce((a + b) / 2, a, b), 6) AS power FROM (
  SELECT event_id, event_type, CASE WHEN abs(epoch(date_trunc('second', lag(ts) OVER w)) - epoch(date_trunc('second', ts))) <= 21600 THEN lag(value) OVER w END AS a,
    CASE WHEN abs(epoch(date_trunc('second', lead(ts) OVER w)) - epoch(date_trunc('second', ts))) <= 21600 THEN lead(value) OVER w END AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase'"""


def assertion_rollup(spark, sf):
    """Of each order status: the checks that fail on any record, and an exit code."""
    o = load(spark, sf, "orders")
    checks = {"negative_total": F.col("o_totalprice") < 0, "old": F.year("o_orderdate") < 1993, "no_priority": F.col("o_orderpriority").isNull(), "large": F.col("o_totalprice") > 400_000}
    agg = o.groupBy("o_orderstatus").agg(*[F.bool_or(c).alias(n) for n, c in checks.items()])
    failed = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in checks]))
    return agg.select("o_orderstatus", F.array_join(failed, ",").alias("failed"), F.when(F.size(failed) > 0, 1).otherwise(0).cast("long").alias("exit_code"))


ROLLUP = """
SELECT o_orderstatus, array_to_string(f, ',') AS failed, CASE WHEN len(f) > 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT o_orderstatus, list_filter([CASE WHEN bool_or(o_totalprice < 0) THEN 'negative_total' END, CASE WHEN bool_or(year(o_orderdate) < 1993) THEN 'old' END,
  CASE WHEN bool_or(o_orderpriority IS NULL) THEN 'no_priority' END, CASE WHEN bool_or(o_totalprice > 400000) THEN 'large' END], lambda x: x IS NOT NULL) AS f FROM orders GROUP BY o_orderstatus)"""


def file_availability(spark, sf):
    """Chips (customers) for which all three files exist: orders of three priorities."""
    o = load(spark, sf, "orders")
    has = lambda p: o.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("c_custkey"))
    c = load(spark, sf, "customer").select("c_custkey")
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM"):
        c = c.join(has(p), "c_custkey", "left_semi")
    return c


AVAILABLE = "SELECT c_custkey FROM customer WHERE " + " AND ".join(f"c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '{p}')" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM"))


def fuzzy_names(spark, sf):
    """Of each brand the part name whose length is closest to 12, then the shortest, then by name; and a hash-ordered sample of three."""
    p = load(spark, sf, "part").select("p_brand", "p_name").distinct()
    best = F.min_by("p_name", F.struct(F.abs(F.length("p_name") - 12), F.length("p_name"), "p_name"))
    return p.groupBy("p_brand").agg(best.alias("closest"), F.max(F.length("p_name")).cast("long").alias("longest"))


NAMES = "SELECT p_brand, first(p_name ORDER BY abs(length(p_name) - 12), length(p_name), p_name) AS closest, max(length(p_name)) AS longest FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand"


def plan_validation(spark, sf):
    """Plans put right: a bad intent becomes an address, only known steps stay, required ones are added, in a fixed order."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("plan"), F.when(F.col("n_nationkey") % 4 == 0, "address").when(F.col("n_nationkey") % 4 == 1, "area").otherwise("?").alias("intent"), F.split("n_name", "").alias("steps"))
    known = F.array(*[F.lit(s) for s in "AEIOU"])
    kept = F.array_union(F.array(F.lit("X")), F.array_intersect(known, "steps"))
    return n.select("plan", F.when(F.col("intent") == "?", "address").otherwise(F.col("intent")).alias("intent"), F.array_join(kept, ">").alias("steps"))


PLANS = """
SELECT n_nationkey AS plan, CASE WHEN n_nationkey % 4 = 1 THEN 'area' ELSE 'address' END AS intent, array_to_string(list_concat(['X'], list_filter(['A', 'E', 'I', 'O', 'U'], lambda s: contains(n_name, s))), '>') AS steps FROM nation"""


def blending_note(spark, sf):
    """A note where a question's place is only a part of the area it is answered for."""
    area = F.lit("Carroll Gardens-Cobble Hill-Gowanus-Red Hook")
    parts = F.transform(F.split(area, "-"), F.lower)
    named = F.filter(parts, lambda p: F.lower("query").contains(p))
    note = F.when((F.size(named) > 0) & (F.size(parts) > 1), F.concat(F.lit("covers also: "), F.array_join(F.array_except(parts, named), ", ")))
    return questions(spark, sf).select("id", note.alias("note"))


BLENDING = f"""
SELECT id, CASE WHEN len(named) > 0 THEN 'covers also: ' || array_to_string(list_filter(parts, lambda p: NOT list_contains(named, p)), ', ') END AS note FROM (
  SELECT id, parts, list_filter(parts, lambda p: contains(lower(query), p)) AS named FROM (SELECT id, query, ['carroll gardens', 'cobble hill', 'gowanus', 'red hook'] AS parts FROM {_QUESTION}))"""

QUERIES = {
    "depth_labels": (depth_labels, DEPTHS), "borough_detection": (borough_detection, BOROUGH), "tide_narrative": (tide_narrative, TIDE), "weather_narrative": (weather_narrative, WEATHER), "framing_score": (framing_score, FRAMING_SCORE),
    "opening_sentence": (opening_sentence, OPENING), "token_estimate": (token_estimate, TOKENS), "bracketed_power": (bracketed_power, POWER), "assertion_rollup": (assertion_rollup, ROLLUP), "file_availability": (file_availability, AVAILABLE),
    "fuzzy_names": (fuzzy_names, NAMES), "plan_validation": (plan_validation, PLANS), "blending_note": (blending_note, BLENDING),
}
