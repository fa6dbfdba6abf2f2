"""Parquet tables with declared layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.times import bytes_to_mb
from vacantia.schema import TABLES


def scan_table(
    spark: SparkSession, path: str, name: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """One stored table; nothing is inferred when the layout is known."""
    layout = schema or (TABLES[name] if name else None)
    reader = spark.read.schema(layout) if layout else spark.read
    return reader.parquet(path)


def stored_size(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Bytes on disk in MB. Only file lengths are read, never the contents."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        bytes_to_mb(F.coalesce(F.sum("length"), F.lit(0))).alias("size_mb"),
    )
