"""Exact quantiles of groups that no task could hold, by selection in passes.

The values next to a quantile's place are targets. In each pass the values that can still be a target's are described by EDGES quantiles of
bounded sketches, which are combined before they are shuffled; counts of the values below and up to the two edges around the target's place
then tell, exactly, whether it is below, between, above or one of them. Each pass leaves about one in EDGES / 5 of the values. Once LIMIT
or fewer are left they are sorted: no task holds more for a target, whatever the group's size.

Edge cases: null, undefined and infinite values are left out; groups without values have null quantiles; a null group is a group; equal values
are one edge, so that a group of one value takes one pass; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path

LIMIT = 10_000
EDGES = 500
ACCURACY = 10_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _active(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The values (g, v) that can still be a target's, with its columns; the join is split where a group is hot."""
    t = targets.select(F.col("g").alias("tg"), "k", "low", "high", "below")
    return rows.join(t, F.col("g").eqNullSafe(F.col("tg"))).where("(low IS NULL OR v > low) AND (high IS NULL OR v < high)").drop("tg")


def _narrowed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """g, k, low, high, below, value, left: each target after a pass; low and high are excluded, below counts the values up to low, left those between."""
    active = _active(rows, targets)
    fractions = F.lit([i / EDGES for i in range(EDGES + 1)])
    sketched = active.groupBy("g", "k").agg(F.count("*").alias("n"), F.first("below").alias("below"), F.percentile_approx("v", fractions, ACCURACY).alias("edges"))
    at = (F.col("k") - F.col("below")) / F.col("n") * EDGES
    edge = lambda i: F.element_at("edges", i.cast("int") + 1)
    cut = sketched.select("g", "k", edge(F.greatest(F.floor(at) - 2, F.lit(0))).alias("a"), edge(F.least(F.ceil(at) + 2, F.lit(EDGES))).alias("b"))
    cuts = _stored(cut, "cuts").select(F.col("g").alias("cg"), F.col("k").alias("ck"), "a", "b")
    met = active.join(cuts, F.col("g").eqNullSafe(F.col("cg")) & (F.col("k") == F.col("ck")))
    told = met.groupBy("g", "k").agg(
        *[F.first(c).alias(c) for c in ("low", "high", "below", "a", "b")], F.count_if(F.col("v") < F.col("a")).alias("lt_a"), F.count_if(F.col("v") <= F.col("a")).alias("le_a"),
        F.count_if(F.col("v") < F.col("b")).alias("lt_b"), F.count_if(F.col("v") <= F.col("b")).alias("le_b"), F.count("*").alias("n"),
    )
    k = F.col("k") - F.col("below")
    step = lambda first, second, third, fourth, fifth: F.when(k < F.col("lt_a"), first).when(k < F.col("le_a"), second).when(k < F.col("lt_b"), third).when(k < F.col("le_b"), fourth).otherwise(fifth)
    none = F.lit(None).cast("double")
    return told.select(
        "g", "k", step(F.col("low"), none, F.col("a"), none, F.col("b")).alias("low"), step(F.col("a"), none, F.col("b"), none, F.col("high")).alias("high"),
        step(F.col("below"), F.col("below"), F.col("below") + F.col("le_a"), F.col("below"), F.col("below") + F.col("le_b")).alias("below"),
        step(none, F.col("a"), none, F.col("b"), none).alias("value"), step(F.col("lt_a"), F.lit(0), F.col("lt_b") - F.col("le_a"), F.lit(0), F.col("n") - F.col("le_b")).cast("long").alias("left"),
    )


def order_statistics(rows: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """g, k and value: the k-th smallest value (from 0) of each target's group. rows: g, v; targets: g, k, n (values of the group)."""
    open_ = _stored(targets.select("g", "k", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("value"), F.col("n").alias("left")), "targets")
    found = None
    while True:
        few, many = open_.where(F.col("value").isNull() & (F.col("left") <= limit)), open_.where(F.col("value").isNull() & (F.col("left") > limit))
        sorted_ = _active(rows, few).groupBy("g", "k").agg(F.array_sort(F.collect_list("v")).alias("values"), F.first("below").alias("below"))
        now = open_.where("value IS NOT NULL").select("g", "k", "value").unionByName(sorted_.select("g", "k", F.element_at("values", (F.col("k") - F.col("below")).cast("int") + 1).alias("value")))
        found = now if found is None else found.unionByName(now)
        if many.isEmpty():
            return found
        open_ = _stored(_narrowed(rows, many), "targets")


def quantiles(rows: DataFrame, group: str, value: str, at: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """The group and, by the names of `at`, its quantiles at shares from 0 to 1, interpolated linearly between neighbours."""
    v = F.col(value).cast("double")
    finite = rows.select(F.col(group).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    sizes = _stored(finite.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for name, p in at.items()])
    places = sizes.select("g", "n", F.explode(asked).alias("q")).select("g", "n", "q.name", "q.pos", F.floor("q.pos").alias("k1"), F.ceil("q.pos").alias("k2"))
    targets = places.select("g", "n", F.explode(F.array("k1", "k2")).alias("k")).distinct()
    told = _stored(order_statistics(finite, targets, limit), "statistics")
    both = places
    for k, name in (("k1", "v1"), ("k2", "v2")):
        side = told.select(F.col("g").alias("sg"), F.col("k").alias(k), F.col("value").alias(name))
        both = both.join(side, F.col("g").eqNullSafe(F.col("sg")) & (both[k] == side[k])).drop("sg", side[k])
    between = F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("pos") - F.col("k1"))
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in at]).withColumnRenamed("g", "wide_g")
    groups = rows.select(F.col(group).alias("g")).distinct()
    return groups.join(wide, F.col("g").eqNullSafe(F.col("wide_g")), "left").select(F.col("g").alias(group), *at)
