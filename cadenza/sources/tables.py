"""Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; columns are pruned and filters pushed down by whatever reads it."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def load_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A Parquet table, or None when there is nothing at ``path`` yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
