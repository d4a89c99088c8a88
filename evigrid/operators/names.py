"""Names of areas: a query resolved by five branches of precedence, and the first area that a text names.

``resolve`` tries, in this order: a borough (all of its areas), an alias (the area of that name), a name but for case, a part of a name
with letters only (the closest length first), and such a part of a parent's name. Parts are found by an index of runs of up to three
letters: a query meets the names that hold its rarest run, and is then looked for in them.

``in_texts`` looks for all boroughs, aliases and names at once with an automaton, in tasks; names beyond NAMES_MOST are dealt to several
automata. Of what a text holds counts: the first borough (in the order given) between spaces; else the longest alias; else the longest
name between a space and a space or one of ".,?" (the ends of the text are like spaces); else the longest name anywhere. Names of fewer
than four characters are not looked for.

Edge cases: null and empty queries and texts find nothing; keys are compared in lower case; null names and keys are left out; names that
several areas have stand for all of them; the first area is that with the least code; without areas nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised_name

NAMES_MOST = 200_000
LEAST = 4
RUN = 3
BRANCHES = ("borough", "alias", "exact", "part", "parent")


def _hits(areas: DataFrame, key, name: str) -> DataFrame:
    """The areas of each key: the least code and their number."""
    return areas.select(key.alias(name), "code").where(f"{name} IS NOT NULL AND {name} <> ''").groupBy(name).agg(F.min("code").alias("code"), F.count("*").alias("n_hits"))


def _runs(strings: DataFrame, column: str, lengths) -> DataFrame:
    each = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.length(column) - k + 1), lambda i: F.substring(F.col(column), i, k))))
    return strings.select(column, F.explode(F.array_distinct(each)).alias("run"))


def _parts(asked: DataFrame, names: DataFrame) -> DataFrame:
    """q (normalised), code, n_hits: names (name, code, n_hits) that hold q; the closest length first."""
    index = _runs(names, "name", F.sequence(F.lit(1), F.least(F.lit(RUN), F.length("name"))))
    seen = index.groupBy("run").agg(F.count("*").alias("df"))
    runs = _runs(asked, "q", F.array(F.least(F.lit(RUN), F.length("q"))))
    rarest = runs.join(seen, "run").groupBy("q").agg(F.min_by("run", F.struct("df", "run")).alias("run"))
    met = rarest.join(index, "run").where("contains(name, q)").join(names, "name")
    nearest = F.min_by("code", F.struct(F.abs(F.length("name") - F.length("q")), F.col("code"))).alias("code")
    return met.groupBy("q").agg(nearest, F.sum("n_hits").alias("n_hits"))


def resolve(queries: DataFrame, areas: DataFrame, aliases: DataFrame, boroughs: DataFrame) -> DataFrame:
    """id, branch, code (of the first area) and n_hits of each query (id, query) that finds any; areas: code, name, borough, parent;
    aliases: alias, name; boroughs: key, borough."""
    asked = queries.select("id", F.lower(F.trim("query")).alias("low")).where("low <> ''")
    low = asked.select("low").distinct().withColumn("q", normalised_name(F.col("low")))
    normal = low.where("q <> ''").select("q").distinct()
    named = _hits(areas, F.col("name"), "name")
    of_borough = boroughs.select(F.lower("key").alias("low"), "borough").dropDuplicates(["low"]).join(_hits(areas, F.col("borough"), "borough"), "borough")
    of_alias = aliases.select(F.lower("alias").alias("low"), "name").dropDuplicates(["low"]).join(named, "name")
    found = [
        of_borough, of_alias, _hits(areas, F.lower("name"), "low"),
        *[low.join(_parts(normal, _hits(areas, normalised_name(F.col(c)), "name")), "q") for c in ("name", "parent")],
    ]
    every = None
    for place, (branch, rows) in enumerate(zip(BRANCHES, found)):
        one = rows.select("low", F.struct(F.lit(place).alias("place"), F.lit(branch).alias("branch"), "code", F.col("n_hits").cast("long").alias("n_hits")).alias("hit"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("low").agg(F.min_by("hit", "hit.place").alias("hit"))
    return asked.join(best, "low").select("id", "hit.branch", "hit.code", "hit.n_hits")


# ---------------------------------------------------------------- texts


class Finder:
    """All keys at once: (key, kind, place); kinds are borough, alias and name, places the order of precedence within a kind."""

    def __init__(self, keys: list[tuple[str, str, int]]):
        import ahocorasick

        kinds: dict[str, list[tuple[str, int]]] = {}
        for key, kind, place in keys:
            kinds.setdefault(key, []).append((kind, place))
        self.automaton = ahocorasick.Automaton()
        for key, of in kinds.items():
            self.automaton.add_word(key, (key, of))
        if kinds:
            self.automaton.make_automaton()

    def first(self, text: str) -> tuple | None:
        """(rank of the rule, place within it, key) of the best key in a text."""
        low = text.lower()
        best = None
        for end, (key, kinds) in self.automaton.iter(low) if len(self.automaton) else ():
            begin = end - len(key) + 1
            before, after = low[begin - 1 : begin] if begin else " ", low[end + 1 : end + 2] or " "
            for kind, place in kinds:
                if kind == "borough":
                    rank = 0 if before == after == " " else None
                elif kind == "alias":
                    rank = 1
                else:
                    rank = 2 if before == " " and after in " .,?" else 3
                if rank is not None and (best is None or (rank, place) < best[:2]):
                    best = rank, place, key
        return best


def in_texts(documents: DataFrame, areas: DataFrame, aliases: DataFrame, boroughs: DataFrame, names_most: int = NAMES_MOST) -> DataFrame:
    """doc_id, key, rule (0 to 3), code and n_hits: the area that each text (doc_id, text) names first; documents without one are left out."""
    spark = documents.sparkSession
    low = lambda c: F.lower(c).alias("key")
    keys = boroughs.select(low("key"), F.lit("borough").alias("kind"), F.col("ord").cast("long").alias("ord")).unionByName(aliases.select(low("alias"), F.lit("alias").alias("kind"), F.lit(0).cast("long").alias("ord")))
    keys = keys.unionByName(areas.select(low("name"), F.lit("name").alias("kind"), F.lit(0).cast("long").alias("ord")).where(F.length("key") >= LEAST)).where("key <> ''").groupBy("key", "kind").agg(F.min("ord").alias("ord"))
    resolved = resolve(keys.select(F.col("key").alias("id"), F.col("key").alias("query")), areas, aliases, boroughs).dropDuplicates(["id"]).withColumnRenamed("id", "key")
    useful = keys.join(resolved.select("key"), "key", "left_semi")
    # Longer keys come first, then the lesser ones; boroughs in their own order.
    placed = useful.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("ord", F.desc(F.length("key")), "key")))
    held = [(r.key, r.kind, r.place) for r in placed.orderBy("kind", "place").collect()]  # names of areas: a gazetteer, not documents
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    found = None
    for i in range(0, max(1, len(held)), names_most):
        sent = spark.sparkContext.broadcast(held[i : i + names_most])

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value)
            for batch in batches:
                hits = [finder.first(t or "") for t in batch.column("text").to_pylist()]
                at = [i for i, h in enumerate(hits) if h]
                columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([hits[i][0] for i in at], pa.int64()), pa.array([hits[i][1] for i in at], pa.int64()), pa.array([hits[i][2] for i in at], pa.string())]
                yield pa.record_batch(columns, names=["doc_id", "rule", "place", "key"])

        some = rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rule long, place long, key string")
        found = some if found is None else found.unionByName(some)
    if len(held) > names_most:
        found = found.groupBy("doc_id").agg(F.min(F.struct("rule", "place", "key")).alias("b")).select("doc_id", "b.*")
    return found.join(F.broadcast(resolved) if len(held) <= NAMES_MOST else resolved, "key").select("doc_id", "key", "rule", "code", "n_hits")
