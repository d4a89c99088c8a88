"""Readers of points and polygons from files, through Spark's own sources; and fetches of rows by a function given by the caller."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = "array<array<array<double>>>"


def geojson(spark: SparkSession, path: str, properties: list[str] | None = None) -> DataFrame:
    """ord, kind, lat, lon (points), rings (polygons, of struct x, y), properties (a map, or the listed columns) of each feature."""
    schema = "type string, features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    whole = spark.read.option("multiLine", True).schema(schema).json(path)
    return _features(whole.select(F.posexplode("features").alias("ord", "f")), properties)


def geojson_lines(spark: SparkSession, path: str, properties: list[str] | None = None) -> DataFrame:
    """As geojson, from files with a feature on each line, which any number of tasks can read; ord is null."""
    schema = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
    lines = spark.read.schema(schema).json(path)
    return _features(lines.select(F.lit(None).cast("int").alias("ord"), F.struct("geometry", "properties").alias("f")), properties)


def _features(features: DataFrame, properties: list[str] | None) -> DataFrame:
    rows = features.select("ord", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"), F.col("f.properties").alias("properties"))
    at = F.from_json("c", "array<double>")
    polygon = F.when(F.col("kind") == "Polygon", F.from_json("c", _RING)).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", f"array<{_RING}>")))
    rings = F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    point = F.when(F.col("kind") == "Point", at)
    out = rows.select("ord", "kind", F.get(point, F.lit(1)).alias("lat"), F.get(point, F.lit(0)).alias("lon"), rings.alias("rings"), "properties")
    return out if properties is None else out.select("ord", "kind", "lat", "lon", "rings", *[F.col("properties").getItem(p).alias(p) for p in properties])


def points_only(features: DataFrame) -> DataFrame:
    """Features that are points; others are left out silently."""
    return features.where("kind = 'Point' AND lat IS NOT NULL AND lon IS NOT NULL")


def csv_points(spark: SparkSession, path: str, lat: str = "latitude", lon: str = "longitude", sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with lat and lon as numbers; rows without both are left out."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    return raw.withColumn("lat", F.trim(lat).try_cast("double")).withColumn("lon", F.trim(lon).try_cast("double")).where("lat IS NOT NULL AND lon IS NOT NULL")


def json_path(text: Column, path: str) -> Column:
    """The value at a path such as a.b[0].c in JSON text; null where there is none."""
    return F.get_json_object(text, f"$.{path}")


def request_url(template: str, environment: dict[str, str], columns: dict[str, Column]) -> Column:
    """The address of each row's request: ${NAME} comes from the environment (left out where it has none), then {name} from a column."""
    whole = re.sub(r"\$\{(\w+)\}", lambda m: environment.get(m[1], ""), template)
    parts = re.split(r"\{(\w+)\}", whole)
    unknown = [n for n in parts[1::2] if n not in columns]
    if unknown:
        raise ValueError(f"no column for {{{unknown[0]}}}")
    return F.concat(*[columns[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def fetched(queries: DataFrame, fetch: Callable[[dict], object], schema: str = "query_id long, status string, value string, error string") -> DataFrame:
    """A row for each query: what `fetch` gives for it as JSON text, or why it failed. Failure is data and stops no other query."""
    import json

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    value = fetch(row)
                    rows.append((row["query_id"], "offline" if value is None else "ok", None if value is None else json.dumps(value, sort_keys=True), None))
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises belongs to its row
                    rows.append((row["query_id"], "error", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["query_id", "status", "value", "error"])

    return queries.mapInPandas(call, schema)


def not_a_stub(spark: SparkSession, path: str) -> None:
    """Refuses a text stub that stands for a large file kept elsewhere (small, and it begins with a pointer's version line)."""
    found = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 24).cast("string").alias("head")).where("length < 1024").collect()
    if any((r["head"] or "").startswith("version https://git-lfs") for r in found):
        raise FileNotFoundError(f"{path} is a pointer to a large file: fetch the file itself first")
