"""Zones on disk: bronze/<source>/kind=<data|cdc|error|dead_letter>/run_id=<run>, read tolerantly or strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("data", "cdc", "error", "dead_letter")


def read_tolerant(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value variant) of every readable JSON line; blank and malformed lines are left out."""
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return raw.select("file", F.col("value").alias("line"), F.try_parse_json("value").alias("value")).filter("value is not null")


def read_strict(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """JSON lines of a schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def read_zone(spark: SparkSession, root: str, source: str, *kinds: str) -> DataFrame:
    """All runs of a source with kind and run_id as columns, pruned by kind; ragged files are merged."""
    df = spark.read.option("basePath", f"{root}/{source}").option("mergeSchema", "true").json(f"{root}/{source}")
    return df.filter(F.col("kind").isin(*(kinds or ("data",))))


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_stats(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes, rows): non-blank lines of every file."""
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value")
    return raw.groupBy("file", "bytes").agg(F.count_if(F.trim("value") != "").alias("rows"))


def counts_by_prefix(names: DataFrame, column: str) -> DataFrame:
    """Rows by the text before the first underscore of a file name."""
    return names.groupBy(F.substring_index(column, "_", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
