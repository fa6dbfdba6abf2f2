"""Streams: many micro-batches give the batch result; a repeated batch changes nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators.changes import change_log
from vacantia.operators.latest import latest_by_key
from vacantia.streaming import ingest

T0 = dt.datetime(2026, 1, 1)
SNAPSHOT = (
    T.StructType().add("job_id", T.StringType()).add("scraped_at", T.TimestampNTZType())
    .add("seq", T.LongType()).add("salary", T.StringType())
)


@pytest.fixture()
def feed(spark, tmp_path):
    """Snapshots in five files, in time order; one job holds a third of the rows."""
    rng = random.Random(5)
    rows = [
        ("hot" if rng.random() < 0.33 else f"j{rng.randrange(15)}", T0 + dt.timedelta(minutes=i), i,
         rng.choice(["1", "2", None]))
        for i in range(200)
    ]
    folder = tmp_path / "feed"
    for n in range(5):
        part = spark.createDataFrame(rows[n * 40:(n + 1) * 40], SNAPSHOT)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.createDataFrame(rows, SNAPSHOT), str(folder)


def stream(spark, folder):
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingest_equals_batch(spark, feed, tmp_path, rows_of):
    whole, folder = feed
    snapshots, changes = str(tmp_path / "snapshots"), str(tmp_path / "changes")
    handle = ingest.ingest_handler(snapshots, changes, SNAPSHOT, fields=["salary"], tie_break=["seq"])
    query = ingest.start(stream(spark, folder), str(tmp_path / "cp"), handle)
    query.awaitTermination()
    log = ingest.read_log(spark, snapshots, SNAPSHOT)
    assert log.select(ingest.BATCH).distinct().count() == 5
    columns = ["job_id", "changed_at", "field_name", "old_value", "new_value"]
    expected = rows_of(change_log(whole, fields=["salary"], tie_break=["seq"]).select(columns))
    assert rows_of(spark.read.parquet(changes).select(columns)) == expected
    current = ingest.current_rows(log, "job_id", ["scraped_at", "seq"])
    assert rows_of(current) == rows_of(latest_by_key(whole, "job_id", ["scraped_at", "seq"]))

    # A batch run again, whatever later batches have written, leaves the same tables.
    for batch_id in (4, 2):
        again = ingest.read_log(spark, snapshots, SNAPSHOT)
        again = again.filter(F.col(ingest.BATCH) == batch_id).drop(ingest.BATCH)
        frozen = spark.createDataFrame(again.collect(), SNAPSHOT)
        handle(frozen, batch_id)
    assert rows_of(spark.read.parquet(changes).select(columns)) == expected

    # Compaction keeps the current rows and the log can go on from it.
    compacted = str(tmp_path / "compacted")
    ingest.compact(spark, snapshots, SNAPSHOT, "job_id", ["scraped_at", "seq"], 4, compacted)
    small = ingest.read_log(spark, compacted, SNAPSHOT)
    assert rows_of(ingest.current_rows(small, "job_id", ["seq"])) == rows_of(
        latest_by_key(whole, "job_id", ["scraped_at", "seq"]))
    assert small.count() == whole.select("job_id").distinct().count()


def test_arrival_order_wins(spark, tmp_path, rows_of):
    """A late snapshot still overwrites and is compared with what was stored before it."""
    snapshots, changes = str(tmp_path / "s"), str(tmp_path / "c")
    handle = ingest.ingest_handler(snapshots, changes, SNAPSHOT, fields=["salary"], tie_break=["seq"])
    handle(spark.createDataFrame([("1", T0, 1, "new")], SNAPSHOT), 0)
    handle(spark.createDataFrame([("1", T0 - dt.timedelta(days=9), 0, "old")], SNAPSHOT), 1)
    assert rows_of(spark.read.parquet(changes).select("old_value", "new_value")) == [("new", "old")]
    log = ingest.read_log(spark, snapshots, SNAPSHOT)
    assert ingest.current_rows(log, "job_id", ["scraped_at", "seq"]).first().salary == "old"


def test_profile_reload(spark, feed, tmp_path):
    """Profiles disabled between two batches stop at the next batch."""
    _, folder = feed
    profiles, target = str(tmp_path / "profiles"), str(tmp_path / "routed")
    layout = "id string, name string, enabled boolean"
    spark.createDataFrame([("hot", "h", True), ("j1", "one", True)], layout).write.parquet(profiles)
    inner = ingest.routing_handler(profiles, target, "job_id", ["seq"])

    def handle(batch, batch_id):
        inner(batch, batch_id)
        if batch_id == 1:
            spark.createDataFrame([("hot", "h", False), ("j1", "one", True)], layout).write.mode(
                "overwrite").parquet(profiles)

    ingest.start(stream(spark, folder), str(tmp_path / "cp"), handle).awaitTermination()
    names = {
        r.batch_id: set(r.names) for r in spark.read.parquet(target).groupBy(ingest.BATCH)
        .agg(F.collect_set("profile_name").alias("names")).collect()
    }
    assert "h" in names[0] and "h" in names[1]
    assert all("h" not in seen for batch, seen in names.items() if batch > 1)


def test_change_counts(spark, feed, tmp_path, rows_of):
    whole, folder = feed
    changes = stream(spark, folder).select(
        F.col("scraped_at").cast("timestamp").alias("changed_at"), F.lit("salary").alias("field_name"))
    target = str(tmp_path / "counts")
    handle = ingest.latest_state_handler(target)
    ingest.start(ingest.change_counts(changes), str(tmp_path / "cp"), handle, mode="update").awaitTermination()
    schema = (T.StructType().add("window_start", T.TimestampType()).add("field_name", T.StringType())
              .add("changes", T.LongType()))
    log = ingest.read_log(spark, target, schema)
    latest = latest_by_key(log, ["window_start", "field_name"], ingest.BATCH).drop(ingest.BATCH)
    expected = whole.groupBy(F.date_trunc("hour", F.col("scraped_at").cast("timestamp")).alias("w")).count()
    assert rows_of(latest.select("window_start", "changes")) == rows_of(expected)
