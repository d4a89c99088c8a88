"""Writers: ranked registers, feature collections, JSON lines, and appends that resume."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_csv(register: DataFrame, path: str, score: str = "score", name: str = "name") -> None:
    """Highest score first, names breaking ties; Spark writes the ranges in order."""
    register.orderBy(F.desc(score), name).write.mode("overwrite").option("header", True).csv(path)


def feature(lat: Column, lon: Column, properties: list[str]) -> Column:
    """A GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def feature_lines(points: DataFrame, path: str, properties: list[str]) -> None:
    """A feature a line (newline-delimited GeoJSON), so that any number of tasks can write."""
    points.select(feature(F.col("lat"), F.col("lon"), properties).alias("value")).write.mode("overwrite").text(path)


def feature_collections(points: DataFrame, by: list[str], properties: list[str]) -> DataFrame:
    """A GeoJSON FeatureCollection as text for each group, such as a tile of a map, whose points one answer can hold."""
    listed = points.groupBy(*by).agg(F.array_sort(F.collect_list(feature(F.col("lat"), F.col("lon"), properties))).alias("features"))
    return listed.select(*by, F.size("features").cast("long").alias("n"), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("features", ","), F.lit("]}")).alias("collection"))


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str) -> int:
    """Appends rows whose rounded coordinates the table does not have yet; a rerun after a failure goes on where it stopped."""
    key = [F.round("lat", 5).alias("_lat"), F.round("lon", 5).alias("_lon")]
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*key).distinct()
    except AnalysisException as e:  # the table does not exist before the first run
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = None
    keyed = rows.withColumn("_lat", key[0]).withColumn("_lon", key[1])
    new = keyed if done is None else keyed.join(done, ["_lat", "_lon"], "left_anti")
    new.drop("_lat", "_lon").write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def payload_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
