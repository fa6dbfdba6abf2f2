"""Keyed merges of a stored table with a batch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.text import normalize_company
from vacantia.functions.times import days_after, instant
from vacantia.operators.latest import latest_by_key
from vacantia.session import work_dir

BUCKET = "bucket"


def complete_batch(batch: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    """Fills the normalised company and the last-seen time where the batch has none."""
    def filled(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in batch.columns else default

    return batch.withColumns({
        "normalized_company_name": filled("normalized_company_name", normalize_company(F.col("company"))),
        "last_seen": filled("last_seen", instant(as_of)),
    })


def upsert_replace(
    table: DataFrame, batch: DataFrame, key: str, order: str | Sequence[str]
) -> DataFrame:
    """Whole-row replace: the last batch row per key wins over the stored row.

    Only the batch is reduced; the stored table meets the batch keys in an anti join, which
    needs no shuffle of the table while the keys are small enough to broadcast.
    """
    fresh = latest_by_key(batch, key, order).drop(
        *[c for c in ([order] if isinstance(order, str) else order) if c not in table.columns]
    )
    kept = table.join(batch.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_counts(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Input rows (the reported count), distinct keys, and how many of them were known."""
    keys = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = table.select(key, F.lit(True).alias("_known"))
    return keys.join(known, key, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("input_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count("_known").alias("replaced"),
    )


def merge_keep(
    table: DataFrame,
    batch: DataFrame,
    key: str,
    keep: Sequence[str],
    update: Sequence[str] | None = None,
) -> DataFrame:
    """Insert or update; ``keep`` columns stay as first stored.

    ``batch`` holds one row per key. Columns in ``update`` take the batch value even when it
    is NULL; columns in neither list are untouched for known keys.
    """
    columns = table.columns
    changed = [c for c in (update or columns) if c not in keep and c != key and c in batch.columns]
    old = table.withColumn("_old", F.lit(True)).alias("o")
    new = batch.withColumn("_new", F.lit(True)).alias("n")
    is_new = F.col("n._new").isNotNull()
    is_old = F.col("o._old").isNotNull()

    def merged(name: str) -> Column:
        if name not in batch.columns:
            return F.col(f"o.{name}")
        if name in changed:
            return F.when(is_new, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        return F.when(is_old, F.col(f"o.{name}")).otherwise(F.col(f"n.{name}"))

    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(
        F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key),
        *[merged(c).alias(c) for c in columns if c != key],
    ).select(*columns)


def enrichment_merge(
    companies: DataFrame,
    batch: DataFrame,
    as_of: Column | datetime | str,
    order: str | Sequence[str],
    refresh_days: int = 30,
) -> DataFrame:
    """Company facts keyed by normalised name; the next refresh is due after 30 days."""
    now = instant(as_of)
    stamped = batch.withColumns({
        "normalized_company_name": normalize_company(F.col("company_name")),
        "scraped_at": now,
        "next_refresh_at": days_after(now, refresh_days),
    })
    fresh = latest_by_key(stamped, "normalized_company_name", order)
    return merge_keep(companies, fresh, "normalized_company_name", keep=[])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(
    table: DataFrame, path: str, key: str, buckets: int, files_per_bucket: int = 8
) -> None:
    """Write a keyed table so that later upserts rewrite only the buckets they touch.

    Rows are shuffled by bucket and key hash, so a bucket is written by several tasks, and
    sorted by key, so a search for a few keys reads few Parquet pages. Choose the two numbers
    so that a file is some hundred MB; ``spark.sql.shuffle.partitions`` should reach their
    product on a first full write. The whole table is replaced: no row, bucket or file of an
    earlier write stays.
    """
    (
        table.withColumn(BUCKET, bucket_of(key, buckets))
        .repartition(F.col(BUCKET), F.pmod(F.xxhash64(F.lit("file"), F.col(key)), F.lit(files_per_bucket)))
        .sortWithinPartitions(BUCKET, key)
        .write.mode("overwrite").partitionBy(BUCKET)
        .option("partitionOverwriteMode", "static").parquet(path)
    )


def upsert_into(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: str,
    order: str | Sequence[str],
    buckets: int,
) -> None:
    """:func:`upsert_replace` on stored Parquet: rewrite the touched buckets.

    Only bucket numbers (at most ``buckets``) come to the driver, to prune the scan. The new buckets are written to the shared folder first and copied in from there, so the
    table is never read and overwritten by one job, and a failed copy can be repeated. With
    a table format that has MERGE INTO, use that instead. Batch columns that the table lacks are
    left out; ``buckets`` has to be the number the table was written with.
    """
    touched = [
        row[0] for row in batch.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect()
    ]
    if not touched:
        return
    stored = spark.read.parquet(path)
    if not stored.filter(F.col(BUCKET) != bucket_of(key, buckets)).isEmpty():
        raise ValueError(f"{path} was not written with {buckets} buckets")
    current = stored.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    staged = work_dir(spark, "upsert")
    merged = upsert_replace(current, batch, key, order).select(*current.columns)
    write_bucketed(merged, staged, key, buckets)
    (
        spark.read.parquet(staged).sortWithinPartitions(BUCKET, key)
        .write.mode("overwrite").partitionBy(BUCKET)
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def id_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of two sets → added, removed or kept."""
    before = old.select(key).distinct().withColumn("_old", F.lit(True))
    after = new.select(key).distinct().withColumn("_new", F.lit(True))
    kind = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .otherwise("kept")
    )
    return before.join(after, key, "full_outer").select(key, kind.alias("change_type"))
