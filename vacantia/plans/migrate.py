"""Legacy JSON lines → postings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.latest import latest_by_key
from vacantia.operators.merge import upsert_into, upsert_replace, write_bucketed
from vacantia.sources.jsonl import accepted, legacy_to_jobs, parse_jsonl

_ORDER = ["_file", "_line"]


def migrated(
    records: DataFrame, as_of: Column | datetime | str, order: str | list[str],
    table: DataFrame | None = None,
) -> DataFrame:
    """Good legacy records as postings, the last line per id winning, merged into a table."""
    keys = [order] if isinstance(order, str) else order
    good = accepted(records)
    last = latest_by_key(good, "job_id", order)
    jobs = legacy_to_jobs(last.drop(*keys), as_of)
    if table is None:
        return jobs
    return upsert_replace(table, jobs, "job_id", "scraped_at")


def _exists(spark: SparkSession, path: str) -> bool:
    """Is there a table, by the file system that the path belongs to?"""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(folder)


def migrate_files(
    spark: SparkSession, source: str, target: str, as_of: Column | datetime | str, buckets: int
) -> DataFrame:
    """Reads a folder of JSON lines, merges them into the posting table, returns the counts.

    A table that exists keeps its other postings; otherwise it is written for the first time.
    Lines are ordered by file and by position in it, as far as Spark's row ids tell.
    """
    lines = spark.read.text(source).withColumns({
        "_file": F.input_file_name(), "_line": F.monotonically_increasing_id(),
    })
    records = parse_jsonl(lines, "value")
    postings = migrated(records, as_of, _ORDER)
    if _exists(spark, target):
        upsert_into(spark, target, postings, "job_id", "scraped_at", buckets)
    else:
        write_bucketed(postings, target, "job_id", buckets)
    return records.select("job_id", "_corrupt_record").agg(
        F.count_if(F.col("_corrupt_record").isNull()).alias("migrated"),
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("rejected"),
    )
