"""The stored table and the keyed state: many batches, failures, repeats, late files, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators.changes import change_log
from vacantia.operators.latest import latest_by_key
from vacantia.operators.stored_table import StoredTable
from vacantia.streaming import detection, ingest

T0 = dt.datetime(2026, 1, 1)
SNAPSHOT = (
    T.StructType().add("job_id", T.StringType()).add("scraped_at", T.TimestampNTZType())
    .add("seq", T.LongType()).add("salary", T.StringType())
)
EDIT = ["job_id", "changed_at", "field_name", "old_value", "new_value"]
ORDER = ["scraped_at", "seq"]


def history(seed, n=200):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.33 else f"j{rng.randrange(30)}", T0 + dt.timedelta(minutes=i // 2), i,
             rng.choice(["1", "2", None])) for i in range(n)]


def applied(spark, path, parts, start=0, buckets=8):
    for n, part in enumerate(parts, start):
        StoredTable.open(spark, path, SNAPSHOT, "job_id", buckets).upsert(spark.createDataFrame(part, SNAPSHOT), n, ORDER, ["salary"])
    return StoredTable.open(spark, path, SNAPSHOT, "job_id", buckets)


def test_batches_equal_the_whole(spark, tmp_path, rows_of):
    rows = history(1)
    table = applied(spark, str(tmp_path / "t"), [rows[i:i + 50] for i in range(0, 200, 50)])
    whole = spark.createDataFrame(rows, SNAPSHOT)
    assert rows_of(table.read()) == rows_of(latest_by_key(whole, "job_id", ORDER))
    assert rows_of(table.changes().select(EDIT)) == rows_of(change_log(whole, fields=["salary"], tie_break=["seq"]).select(EDIT))
    assert rows_of(table.keys_of(["hot", "nobody"])) == rows_of(latest_by_key(whole, "job_id", ORDER).filter("job_id = 'hot'"))
    assert len(table.obsolete()) > 0


def test_repeated_and_failed_batches_leave_the_same_table(spark, tmp_path, rows_of, monkeypatch):
    rows, path = history(2), str(tmp_path / "t")
    table = applied(spark, path, [rows[:100]])
    before = rows_of(table.read())
    # A batch that is done already changes nothing, whatever it holds.
    assert table.upsert(spark.createDataFrame(rows[100:], SNAPSHOT), 0, ORDER, ["salary"]).version == 1
    # A batch that fails after its files are written: readers see the old version, the next attempt replaces them.
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_write_changes", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame([("j1", T0, 999, "wrong"), ("new", T0, 1000, "wrong")], SNAPSHOT), 1, ORDER, ["salary"])
    assert rows_of(StoredTable.open(spark, path, SNAPSHOT, "job_id", 8).read()) == before
    table = applied(spark, path, [rows[100:]], start=1)
    whole = spark.createDataFrame(rows, SNAPSHOT)
    assert rows_of(table.read()) == rows_of(latest_by_key(whole, "job_id", ORDER))
    assert rows_of(table.changes().select(EDIT)) == rows_of(change_log(whole, fields=["salary"], tie_break=["seq"]).select(EDIT))


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    path = tmp_path / "t"
    table = applied(spark, str(path), [history(3)], buckets=16)
    assert len(table.versions) > 8
    after = applied(spark, str(path), [[("j1", T0, 500, "9")]], start=1, buckets=16)
    assert len(list((path / "data" / "version=2").glob("bucket=*"))) == 1
    changed = [b for b, v in after.versions if v == 2]
    assert len(changed) == 1 and dict(after.versions).keys() == dict(table.versions).keys()
    files = after.keys_of(["j1"]).inputFiles()
    assert files and all(f"version=2/bucket={changed[0]}/" in f for f in files)
    assert len(after.obsolete()) == 1 and after.obsolete()[0].endswith(f"version=1/bucket={changed[0]}")


def test_odd_batches(spark, tmp_path, rows_of):
    path = str(tmp_path / "t")
    empty = StoredTable.open(spark, path, SNAPSHOT, "job_id", 4)
    assert empty.read().count() == 0 and empty.changes().count() == 0
    table = applied(spark, path, [[], [(None, T0, 1, "x")], [("a", T0, 1, None), ("a", T0, 1, None)]], buckets=4)
    assert rows_of(table.read()) == [("a", T0, 1, None)]
    late = table.upsert(spark.createDataFrame([("a", T0 - dt.timedelta(days=9), 0, "old")], SNAPSHOT), 7, ORDER, ["salary"])
    assert late.read().first().salary == "old"
    assert [(r.old_value, r.new_value) for r in late.changes().collect()] == [(None, "old")]


# ---- keyed state -----------------------------------------------------------------------------------


def feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(folder)


def run_once(spark, folder, base):
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(folder)
    edits = detection.detect_changes(stream, fields=["salary"], tie_break=["seq"])
    with detection.stateful_session(spark, 2):
        query = (edits.writeStream.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True)
                 .format("parquet").option("path", f"{base}/out").start())
    query.awaitTermination()
    return spark.read.schema(edits.schema).parquet(f"{base}/out")


def by_arrival(parts):
    """Edits when every file is put in order and files come one after another."""
    held, out = {}, []
    for part in parts:
        for job, at, seq, salary in sorted((r for r in part if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
            if job in held and held[job] != salary:
                out.append((job, at, "salary", held[job], salary))
            held[job] = salary
    return sorted(out, key=repr)


def test_state_goes_on_after_a_restart(spark, tmp_path, rows_of):
    rows, folder, base = history(4), str(tmp_path / "feed"), str(tmp_path)
    feed(spark, folder, [rows[:60], rows[60:90]])
    store = spark.conf.get(detection.STATE_STORE[0], None)
    run_once(spark, folder, base)
    assert spark.conf.get(detection.STATE_STORE[0], None) == store
    # New files after the stop; one is late, one holds rows without key or time.
    late = [("hot", T0 - dt.timedelta(days=3), -1, "late"), ("j1", T0 - dt.timedelta(days=2), -2, None)]
    more = [rows[90:150], late, [(None, T0, 1, "x"), ("j2", None, 2, "x")], rows[150:]]
    feed(spark, folder, more)
    got = run_once(spark, folder, base)
    assert rows_of(got.select(EDIT)) == by_arrival([rows[:60], rows[60:90], *more])


def test_state_in_time_order_equals_the_batch(spark, tmp_path, rows_of):
    rows, folder = history(5), str(tmp_path / "feed")
    feed(spark, folder, [rows[i:i + 50] for i in range(0, 200, 50)])
    expected = change_log(spark.createDataFrame(rows, SNAPSHOT), fields=["salary"], tie_break=["seq"]).select(EDIT)
    assert rows_of(run_once(spark, folder, str(tmp_path)).select(EDIT)) == rows_of(expected)


def test_stored_stream_with_gate(spark, tmp_path, rows_of):
    rows, folder, path = history(6), str(tmp_path / "feed"), str(tmp_path / "t")
    feed(spark, folder, [rows[i:i + 40] for i in range(0, 200, 40)])
    handle = ingest.stored_handler(path, SNAPSHOT, "job_id", ORDER, 4, ["salary"], required=("job_id", "salary"))
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.start(stream, str(tmp_path / "cp"), handle).awaitTermination()
    good = spark.createDataFrame(rows, SNAPSHOT).filter(F.col("salary").isNotNull())
    table = StoredTable.open(spark, path, SNAPSHOT, "job_id")
    assert table.version == 5 and table.batch == 4 and table.buckets == 4
    assert rows_of(table.read()) == rows_of(latest_by_key(good, "job_id", ORDER))
    assert rows_of(table.changes().select(EDIT)) == rows_of(change_log(good, fields=["salary"], tie_break=["seq"]).select(EDIT))
