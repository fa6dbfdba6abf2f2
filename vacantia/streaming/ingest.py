"""Continuous ingest.

Every job writes one folder per micro-batch and only ever overwrites its own folder, from
inputs of earlier batches alone. A batch that is run again after a failure therefore leaves
the same result, whatever the first attempt left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vacantia import constants as C
from vacantia.operators.changes import change_log
from vacantia.operators.filters import enabled_profiles, quality_gate
from vacantia.operators.latest import latest_by_key
from vacantia.operators.lookup import lookup
from vacantia.operators.stored_table import StoredTable

BATCH = "batch_id"


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/{BATCH}={batch_id}"


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(batch_path(path, batch_id))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written so far, with their number."""
    layout = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(layout).parquet(path)


def current_rows(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Merge on read: the last arrived row per key."""
    return latest_by_key(log, key, [BATCH, *order]).drop(BATCH)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str,
            order: Sequence[str], upto: int, target: str) -> None:
    """Writes the rows current after batch ``upto`` as batch ``upto`` of a new log.

    Restart the stream on the new log; the old one stays until nobody reads it.
    """
    log = read_log(spark, path, schema).filter(F.col(BATCH) <= upto)
    write_batch(current_rows(log, key, order), target, upto)


def start(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
    mode: str = "append", once: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Runs ``handle`` per micro-batch: all available data once, or on a timer."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def ingest_handler(
    snapshots_path: str,
    changes_path: str,
    schema: T.StructType,
    key: str = "job_id",
    time: str = "scraped_at",
    fields: Sequence[str] = C.TRACKED_FIELDS,
    tie_break: Sequence[str] = (),
    required: Sequence[str] = ("job_id",),
) -> Callable[[DataFrame, int], None]:
    """Gate → change log against the last stored state → append snapshots.

    The stored state is read with the tracked columns only and reduced to the keys of the
    batch before it meets it; the edits of a key inside one batch are found as well.
    """
    order = [time, *tie_break]
    narrow = list(dict.fromkeys([key, *order, *fields]))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good = quality_gate(batch, required)
        write_batch(good, snapshots_path, batch_id)
        stored = read_log(spark, snapshots_path, schema).filter(F.col(BATCH) <= batch_id)
        fresh = stored.filter(F.col(BATCH) == batch_id).select(*narrow)
        before = stored.filter(F.col(BATCH) < batch_id).select(*narrow, BATCH).join(
            fresh.select(key).distinct(), key, "left_semi"
        )
        previous = latest_by_key(before, key, [BATCH, *order]).drop(BATCH)
        # Arrival decides: the stored state goes before the batch whatever its own time says.
        earliest = F.lit("0001-01-01").cast(schema[time].dataType)
        both = fresh.unionByName(previous.withColumn(time, earliest))
        edits = change_log(both, key, time, fields, tie_break)
        write_batch(edits, changes_path, batch_id)

    return handle


def latest_state_handler(path: str) -> Callable[[DataFrame, int], None]:
    """Upsert stream: each micro-batch is appended, reads take the last row per key."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return handle


def routing_handler(
    profiles_path: str, target: str, profile_column: str, spread_by: Sequence[str],
    read_profiles: Callable[[SparkSession, str], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Keeps rows of profiles enabled now: profiles are read again for every micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        profiles = (read_profiles or (lambda s, p: s.read.parquet(p)))(spark, profiles_path)
        active = enabled_profiles(profiles).select(
            F.col("id").alias(profile_column), F.col("name").alias("profile_name")
        )
        routed = lookup(batch, active, profile_column, "inner", spread_by=spread_by)
        write_batch(routed, target, batch_id)

    return handle


def change_counts(
    changes: DataFrame, window: str = "1 hour", delay: str | None = None,
    time: str = "changed_at", kind: str = "field_name",
) -> DataFrame:
    """Edits per tumbling window and field.

    Without a ``delay`` every edit counts, however late. A delay bounds the state and drops later
    edits; Spark reports their number as ``numRowsDroppedByWatermark``.
    """
    return (
        (changes.withWatermark(time, delay) if delay else changes)
        .groupBy(F.window(time, window).alias("_w"), kind)
        .agg(F.count(F.lit(1)).alias("changes"))
        .select(F.col("_w.start").alias("window_start"), kind, "changes")
    )


def stored_handler(
    path: str, schema: T.StructType, key: str, order: Sequence[str], buckets: int = 64,
    tracked: Sequence[str] = (), required: Sequence[str] = (), time: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Gate → change log → stored upsert, one version of the table per micro-batch.

    Every call opens the newest version, so a restarted stream and a repeated or failed micro-batch
    come out the same; only the buckets of the micro-batch are read and rewritten.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        good = quality_gate(batch, required) if required else batch
        table = StoredTable.open(batch.sparkSession, path, schema, key, buckets)
        table.upsert(good, batch_id, order, tracked, time)

    return handle
