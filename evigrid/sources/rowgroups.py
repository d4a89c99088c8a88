"""An index of the row groups of Parquet files by the ranges of a key, and reads of the row groups that hold wanted keys only.

``write_clustered`` stores a table by ranges of a key in row groups of a bounded size; ``index`` reads the footers of the files, one task a file, and
keeps the range of the key in each row group; ``read`` meets wanted keys with the ranges and reads just those row groups, a few columns of
them. Files may lie wherever Arrow can read.

Edge cases: row groups without a range (no statistics, or keys that are all null) are always read; null keys are never wanted; without wanted
keys nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

INDEX_SCHEMA = "path string, row_group int, n long, low long, high long"


def write_clustered(rows: DataFrame, key: str, path: str, group_rows: int, parts: int | None = None) -> None:
    """Stores rows by ranges of the key, sorted, in row groups of at most `group_rows` rows."""
    ranged = rows.repartitionByRange(parts, key) if parts else rows.repartitionByRange(key)
    # Blocks are closed by their number of rows: the writer looks at it after every so many.
    ranged.sortWithinPartitions(key).write.option("parquet.block.row.count.limit", group_rows).parquet(path)


def _opened(path: str):
    from pyarrow import fs, parquet

    system, inner = fs.FileSystem.from_uri(path)
    return parquet.ParquetFile(system.open_input_file(inner))


def index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """path, row_group, n (rows), low and high (of the key) of each row group of a folder; stored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                file = _opened(name)
                at = file.schema_arrow.names.index(key)
                for i in range(file.metadata.num_row_groups):
                    group = file.metadata.row_group(i)
                    told = group.column(at).statistics
                    known = told is not None and told.has_min_max
                    rows.append((name, i, group.num_rows, told.min if known else None, told.max if known else None))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["path", "row_group", "n", "low", "high"])

    out = new_path(spark, "row-groups")
    files.repartition(max(1, min(200, files.count()))).mapInArrow(look, INDEX_SCHEMA).write.parquet(out)
    return spark.read.schema(INDEX_SCHEMA).parquet(out)


def chosen(groups: DataFrame, wanted: DataFrame, key: str, cell: int) -> DataFrame:
    """The rows of an index whose range holds a wanted key. Ranges and keys meet by cells of `cell` keys; wide ranges span many."""
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    spread = groups.where("low IS NOT NULL").withColumn("c", F.explode(F.sequence(at(F.col("low")), at(F.col("high")))))
    keys = wanted.where(F.col(key).isNotNull()).select(F.col(key).alias("wanted"), at(F.col(key)).alias("c")).distinct()
    met = spread.join(keys, "c").where("wanted BETWEEN low AND high").select("path", "row_group", "n").distinct()
    return met.unionByName(groups.where("low IS NULL").select("path", "row_group", "n")) if wanted.limit(1).count() else met


def read(groups: DataFrame, wanted: DataFrame, key: str, columns: str, cell: int = 1000) -> DataFrame:
    """The rows with wanted keys (columns is a DDL schema that has the key), from the row groups that hold them."""
    picked = chosen(groups, wanted, key, cell)
    spark = groups.sparkSession
    dealt = picked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "row_group")
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}[c.split()[1]]) for n, c in zip(names, columns.split(", "))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, group in zip(batch.column("path").to_pylist(), batch.column("row_group").to_pylist()):
                yield from _opened(path).read_row_group(group, columns=names).select(names).cast(kinds).to_batches()

    rows = dealt.mapInArrow(fetch, columns)
    return rows.join(wanted.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")
