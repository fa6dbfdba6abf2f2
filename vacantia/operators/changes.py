"""Field change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.times import hours_before, instant
from vacantia.session import work_dir

_PREV, _ROW, _LAST, _SLICE = "_prev_", "_row", "_last", "_slice"


def _unpivot(rows: DataFrame, key: str, time: str, fields: Sequence[str]) -> DataFrame:
    """Rows beside their previous state → one row per field that differs (NULL-safe)."""
    pairs = F.array(*[
        F.struct(
            F.lit(name).alias("field_name"),
            F.col(_PREV + name).cast("string").alias("old_value"),
            F.col(name).cast("string").alias("new_value"),
        )
        for name in fields
    ])
    edited = F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    return (
        rows.select(F.col(key), F.col(time).alias("changed_at"), F.explode(edited).alias("_edit"))
        .select(key, "changed_at", "_edit.*")
    )


def change_log(
    snapshots: DataFrame,
    key: str = "job_id",
    time: str = "scraped_at",
    fields: Sequence[str] = C.TRACKED_FIELDS,
    tie_break: Sequence[str] = (),
    slice_width: str | None = "hour",
) -> DataFrame:
    """Every edit of a tracked field between consecutive snapshots of a key.

    Consecutive rows are compared in two steps so that a key with a huge history is not one
    task: first inside (key, time slice), then across slices, where only the first and last
    row of each slice take part. Both steps read the same shuffle of the snapshots.

    Slices are spans of time. Where one key may have a burst of rows in one span, or all at one time,
    ``slice_width=None`` cuts by number of rows instead: rows are range-partitioned by key and order, and a
    slice is what one partition holds of a key. The narrow rows are written once for that, so that both
    steps see the same slices also after a lost executor.
    """
    order = [time, *tie_break]
    narrow = snapshots.select(key, *dict.fromkeys([*order, *fields]))
    if slice_width is None:
        ranged = narrow.repartitionByRange(key, *order).withColumn(_SLICE, F.spark_partition_id())
        path = work_dir(snapshots.sparkSession, "slices")
        ranged.write.parquet(path)
        narrow = snapshots.sparkSession.read.schema(ranged.schema).parquet(path)
    else:
        narrow = narrow.withColumn(_SLICE, F.date_trunc(slice_width, F.col(time).cast("timestamp")))
    in_slice = Window.partitionBy(key, _SLICE).orderBy(*order)
    sliced = narrow.select(
        "*",
        *[F.lag(name).over(in_slice).alias(_PREV + name) for name in fields],
        F.row_number().over(in_slice).alias(_ROW),
        F.lead(F.lit(True)).over(in_slice).isNull().alias(_LAST),
    )
    across = Window.partitionBy(key).orderBy(*order)
    borders = (
        sliced.filter((F.col(_ROW) == 1) | F.col(_LAST))
        .withColumns({
            **{_PREV + name: F.lag(name).over(across) for name in fields},
            "_follows": F.lag(F.lit(True)).over(across),
        })
        .filter((F.col(_ROW) == 1) & F.col("_follows"))
    )
    inner = sliced.filter(F.col(_ROW) > 1)
    return _unpivot(inner, key, time, fields).unionByName(_unpivot(borders, key, time, fields))


def compare_snapshots(
    incoming: DataFrame,
    existing: DataFrame,
    key: str = "job_id",
    time: str = "scraped_at",
    fields: Sequence[str] = C.TRACKED_FIELDS,
) -> DataFrame:
    """Edits between the stored row and the incoming row of the same key."""
    stored = existing.select(key, *[F.col(name).alias(_PREV + name) for name in fields])
    fresh = incoming.select(key, time, *fields)
    return _unpivot(fresh.join(stored, key), key, time, fields)


def recent_changes(
    changes: DataFrame, jobs: DataFrame, as_of: Column | str, since_hours: int = 24
) -> DataFrame:
    """Edits of the last hours with the title and company of postings that still exist, newest first."""
    recent = changes.filter(F.col("changed_at") >= hours_before(instant(as_of), since_hours))
    ties = [F.asc(c) for c in ("job_id", "field_name") if c in changes.columns]
    return changes_with_jobs(recent, jobs).orderBy(F.desc("changed_at"), *ties)


def changes_with_jobs(changes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Plain join: postings are many; a hot posting's edits are split by the adaptive join."""
    return changes.join(jobs.select("job_id", "title", "company"), "job_id")
