"""Places by name: misspelt names found in a table by an index of character pairs, and the order in which a hit is chosen.

Names and queries are compared as lower-case letters and digits with single spaces. A query of fewer than 4 characters allows no
edit, one of fewer than 8 one, a longer one two.

- Longer queries: two strings within d edits share all but 2 * d of their pairs of neighbouring characters (the ends of a string
  padded, equal pairs numbered), so that of each string's pairs, ordered by how rare they are among the names, the first 2 * d + 1 are
  enough to meet. Strings meet only if their lengths differ by d at most.
- Shorter queries meet names that give the same string when one character is left out of either or both.
- What meets is verified by the edit distance.

Different names and queries are looked up once, however many rows have them.

Edge cases: null or empty queries, and such without letters or digits, find nothing; null names are left out; ties go by name, then by id; an
empty table gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, narrative

EDITS = 2
SHORT = 8


def plain(name: Column) -> Column:
    """Lower-case letters and digits, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def edits_allowed(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 4, 0).when(n < SHORT, 1).otherwise(EDITS)


def _pairs(strings: DataFrame) -> DataFrame:
    """s, n (its length), pair and k (which of the equal pairs of the string it is)."""
    padded = F.concat(F.lit("\x02"), F.col("s"), F.lit("\x03"))
    each = strings.select("s", F.length("s").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("place", "pair"))
    return each.withColumn("k", F.row_number().over(Window.partitionBy("s", "pair").orderBy("place"))).drop("place")


def _first(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The 2 * EDITS + 1 pairs of each string that the fewest names have."""
    ranked = pairs.join(seen, ["pair", "k"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("df", F.lit(0)), "pair", "k")))
    return ranked.where(F.col("rank") <= 2 * EDITS + 1).select("s", "n", "pair", "k")


def _shortened(strings: DataFrame) -> DataFrame:
    """s and each string that is left when no or one character is left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, F.length("s"))))
    return strings.select("s", F.explode(F.array_distinct(F.concat(F.array("s"), cut))).alias("left"))


def near_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """q, name, distance of all different strings (column s, as ``plain`` gives them) within the edits that the query allows."""
    queries, names = (df.select("s").where("s <> ''").distinct() for df in (queries, names))
    pairs = _pairs(names.where(F.length("s") >= SHORT - EDITS))
    # The number of different pairs is bounded by the alphabet, not by the rows.
    seen = pairs.groupBy("pair", "k").agg(F.count("*").alias("df"))
    own, other = _first(_pairs(queries.where(F.length("s") >= SHORT)), seen), _first(pairs, seen)
    renamed = other.select(F.col("s").alias("name"), F.col("n").alias("m"), "pair", "k")
    met = own.join(renamed, ["pair", "k"]).where(F.abs(F.col("n") - F.col("m")) <= EDITS).select(F.col("s").alias("q"), "name")
    short = _shortened(queries.where(F.length("s") < SHORT)).join(_shortened(names.where(F.length("s") <= SHORT)).withColumnRenamed("s", "name"), "left").select(F.col("s").alias("q"), "name")
    near = met.unionByName(short).distinct().withColumn("distance", F.levenshtein("q", "name", EDITS))
    return near.where((F.col("distance") >= 0) & (F.col("distance") <= edits_allowed(F.col("q")))).select("q", "name", F.col("distance").cast("long").alias("distance"))


def resolve(queries: DataFrame, records: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """id, branch, record_id, distance, lat, lon of each query (id, text, hint: the whole question, null allowed).

    records: record_id, name, lat, lon, country. region: min_lon, min_lat, max_lon, max_lat of the area in use. A query whose text or hint
    names a place abroad is looked up in all countries first, and is out of scope ("abroad") unless the best hit lies in the country;
    else the best hit within the region ("region") comes before the best in the country ("national"); "none" without a hit. Better is
    fewer edits, then the name, then the id.
    """
    asked = queries.select("id", plain(F.col("text")).alias("q"), F.coalesce(F.col("text").rlike(narrative.FOREIGN), F.lit(False)).alias("a"), F.coalesce(F.col("hint").rlike(narrative.FOREIGN), F.lit(False)).alias("b"))
    keyed = records.where("record_id IS NOT NULL").withColumn("name", plain(F.col("name"))).where("name <> ''")
    here = F.coalesce(F.lower("country") == "us", F.lit(False))
    hit = lambda when: F.min(F.when(when, F.struct("record_id", "lat", "lon", here.alias("home"))))
    inside = here & geo.within(F.col("lat"), F.col("lon"), *region)
    # What is best of each name: three rows' worth, however many records share it.
    best = keyed.groupBy("name").agg(hit(inside).alias("region"), hit(here).alias("national"), hit(F.lit(True)).alias("all"))
    found = near_names(asked.select(F.col("q").alias("s")), best.select(F.col("name").alias("s"))).join(best, "name")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("distance", "name", F.col(c).alias("hit"))))
    ranked = found.groupBy("q").agg(*[first(c).alias(c) for c in ("region", "national", "all")])
    joined = asked.join(ranked, "q", "left")
    abroad = (F.col("a") | F.col("b")) & ~F.coalesce(F.col("all.hit.home"), F.lit(False))
    choice = F.when(abroad, F.lit(None)).otherwise(F.coalesce("region", "national"))
    branch = F.when(abroad, "abroad").when(F.col("region").isNotNull(), "region").when(F.col("national").isNotNull(), "national").otherwise("none")
    chosen = joined.select("id", branch.alias("branch"), choice.alias("c"))
    return chosen.select("id", "branch", F.col("c.hit.record_id").alias("record_id"), F.col("c.distance").alias("distance"), F.col("c.hit.lat").alias("lat"), F.col("c.hit.lon").alias("lon"))
