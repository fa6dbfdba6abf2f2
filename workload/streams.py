"""R: the streaming jobs, run over all available data."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import work_dir
from vacantia.functions.times import hours_before, instant
from vacantia.operators.stored_table import StoredTable
from vacantia.streaming import detection, ingest
from workload.bindings import ctes, view
from workload.registry import query

EVENTS = (
    T.StructType().add("event_id", T.LongType()).add("ts", T.TimestampNTZType())
    .add("user_id", T.LongType()).add("event_type", T.StringType())
    .add("value", T.DoubleType()).add("props", T.StringType())
)
SNAPSHOT = (
    T.StructType().add("job_id", T.StringType()).add("scraped_at", T.TimestampNTZType())
    .add("event_id", T.LongType()).add("event_type", T.StringType()).add("value_band", T.StringType())
)


def event_stream(spark, sf):
    return spark.readStream.schema(EVENTS).parquet(f"{sf}/events*.parquet")


def snapshot_stream(spark, sf):
    return event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("scraped_at"), "event_id",
        "event_type", F.floor(F.col("value") / 10).cast("string").alias("value_band"))


def _run_ingest(spark, sf):
    base = work_dir(spark, "ingest")
    handle = ingest.ingest_handler(
        f"{base}/snapshots", f"{base}/changes", SNAPSHOT, fields=["event_type", "value_band"],
        tie_break=["event_id"])
    ingest.start(snapshot_stream(spark, sf), f"{base}/checkpoint", handle).awaitTermination()
    return base


_CHANGES = ctes("snapshots") + """,
steps AS (
  SELECT job_id, scraped_at, event_type, value_band, lag(event_type) OVER w AS e, lag(value_band) OVER w AS v,
    row_number() OVER w AS n
  FROM snapshots WINDOW w AS (PARTITION BY job_id ORDER BY scraped_at, event_id)
),
changes AS (
SELECT job_id, scraped_at AS changed_at, 'event_type' AS field_name, e AS old_value, event_type AS new_value
FROM steps WHERE n > 1 AND e IS DISTINCT FROM event_type
UNION ALL SELECT job_id, scraped_at, 'value_band', v, value_band FROM steps
WHERE n > 1 AND v IS DISTINCT FROM value_band)"""

_LATEST = ctes("snapshots") + """
SELECT job_id, scraped_at, event_id, event_type, value_band FROM snapshots
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, event_id DESC) = 1"""


FILES = 4


def fed_in_slices(spark, sf, days=6):
    """The whole of ``events`` as a stream of ``FILES`` files per trigger: one trigger per few days, in order."""
    base = work_dir(spark, "events")
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    first = F.lit("2024-01-01").cast("date")
    cut = F.floor(F.datediff(F.col("ts").cast("date"), first) / days)
    for n in range(30 // days + 1):
        part = events.filter(cut == n) if n else events.filter(cut <= 0)
        part.repartition(FILES).write.mode("append").parquet(base)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", FILES).parquet(base)


def _as_snapshots(events):
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("scraped_at"), "event_id",
        "event_type", F.floor(F.col("value") / 10).cast("string").alias("value_band"))


@query("r1_stored_ingest", ctes("snapshots") + """
SELECT job_id, scraped_at, event_id, event_type, value_band FROM snapshots
WHERE event_type IS NOT NULL AND event_type <> 'error' AND value_band <> '3'
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, event_id DESC) = 1""")
def _(spark, sf):
    """Gate on two fields, change log and stored upsert, batch by batch."""
    base = work_dir(spark, "stored")
    stream = _as_snapshots(fed_in_slices(spark, sf)).withColumns({
        "title": F.when(F.col("event_type") != "error", F.col("event_type")),
        "company": F.when(F.col("value_band") != "3", F.col("value_band")).otherwise("")})
    handle = ingest.stored_handler(
        base, SNAPSHOT, "job_id", ["scraped_at", "event_id"], 8, ["event_type", "value_band"],
        required=("job_id", "title", "company"))
    ingest.start(stream, f"{base}-checkpoint", handle).awaitTermination()
    return StoredTable.open(spark, base, SNAPSHOT, "job_id").read()


@query("r2_keyed_state", _CHANGES + "SELECT * FROM changes")
def _(spark, sf):
    """Edits against the last row of every key in the state store, over several triggers."""
    base = work_dir(spark, "keyed")
    edits = detection.detect_changes(
        _as_snapshots(fed_in_slices(spark, sf)), fields=["event_type", "value_band"], tie_break=["event_id"])
    with detection.stateful_session(spark, spark.sparkContext.defaultParallelism):
        stream = (edits.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
                  .format("parquet").option("path", f"{base}/edits").start())
    stream.awaitTermination()
    return spark.read.schema(edits.schema).parquet(f"{base}/edits")


def _stored_state(spark, sf):
    base = work_dir(spark, "stored")
    handle = ingest.stored_handler(
        base, SNAPSHOT, "job_id", ["scraped_at", "event_id"], 8, ["event_type", "value_band"])
    ingest.start(_as_snapshots(fed_in_slices(spark, sf)), f"{base}-checkpoint", handle).awaitTermination()
    return StoredTable.open(spark, base, SNAPSHOT, "job_id")


@query("r4_stored_upsert", _LATEST)
def _(spark, sf):
    return _stored_state(spark, sf).read()


@query("r4_stored_changes", _CHANGES + "SELECT * FROM changes")
def _(spark, sf):
    return _stored_state(spark, sf).changes()


@query("r1_continuous_ingest", _LATEST)
def _(spark, sf):
    base = _run_ingest(spark, sf)
    log = ingest.read_log(spark, f"{base}/snapshots", SNAPSHOT)
    return ingest.current_rows(log, "job_id", ["scraped_at", "event_id"])


@query("r2_stream_change_detection", _CHANGES + "SELECT * FROM changes")
def _(spark, sf):
    base = _run_ingest(spark, sf)
    return spark.read.parquet(f"{base}/changes").drop(ingest.BATCH)


@query("r3_profile_reload", ctes("profiles") + """
SELECT e.event_id, e.user_id, p.name AS profile_name FROM events e JOIN profiles p ON e.user_id = p.id
WHERE p.enabled""")
def _(spark, sf):
    base = work_dir(spark, "routing")
    handle = ingest.routing_handler(
        sf, f"{base}/routed", "user_id", ["event_id"],
        read_profiles=lambda session, path: view(session, path, "profiles"))
    stream = event_stream(spark, sf).select("event_id", "user_id")
    ingest.start(stream, f"{base}/checkpoint", handle).awaitTermination()
    return spark.read.parquet(f"{base}/routed").drop(ingest.BATCH)


@query("r4_latest_state", _LATEST)
def _(spark, sf):
    base = work_dir(spark, "latest")
    handle = ingest.latest_state_handler(f"{base}/rows")
    ingest.start(snapshot_stream(spark, sf), f"{base}/checkpoint", handle).awaitTermination()
    log = ingest.read_log(spark, f"{base}/rows", SNAPSHOT)
    return ingest.current_rows(log, "job_id", ["scraped_at", "event_id"])


@query("r5_change_feed_windows", """
SELECT date_trunc('hour', ts) AS window_start, event_type AS field_name, count(*) AS changes FROM events
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - to_hours(240) GROUP BY ALL""")
def _(spark, sf):
    base = work_dir(spark, "feed")
    recent = event_stream(spark, sf).filter(
        F.col("ts") >= hours_before(instant("2024-01-30 00:00:00"), 240))
    feed = recent.select(F.col("ts").cast("timestamp").alias("changed_at"),
                         F.col("event_type").alias("field_name"))
    counts = ingest.change_counts(feed)
    handle = ingest.latest_state_handler(f"{base}/counts")
    ingest.start(counts, f"{base}/checkpoint", handle, mode="update").awaitTermination()
    schema = (T.StructType().add("window_start", T.TimestampType()).add("field_name", T.StringType())
              .add("changes", T.LongType()))
    log = ingest.read_log(spark, f"{base}/counts", schema)
    latest = ingest.latest_by_key(log, ["window_start", "field_name"], ingest.BATCH)
    return latest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                         "field_name", "changes")
