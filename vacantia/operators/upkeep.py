"""Retention, delete effects and run times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.times import instant, seconds_before
from vacantia.operators.lookup import lookup


def retention(
    jobs: DataFrame, as_of: Column | datetime | str, max_age_seconds: int, time: str = "scraped_at"
) -> DataFrame:
    """Rows not older than the limit. The cut-off is a constant, so it reaches the scan.

    Rows without a time are not known to be old and stay.
    """
    young = F.col(time) >= seconds_before(instant(as_of), max_age_seconds)
    return jobs.filter(young | F.col(time).isNull())


def cascade(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Child rows whose parent still exists."""
    return children.join(parents.select(on), on, "left_semi")


def set_null_on_parent_delete(
    jobs: DataFrame, profiles: DataFrame, child: str = "profile_id", parent: str = "id",
    spread_by: str = "job_id",
) -> DataFrame:
    """Clears the reference to a parent that is gone."""
    alive = profiles.select(F.col(parent).alias(child), F.lit(True).alias("_alive"))
    joined = lookup(jobs, alive, child, "left", spread_by)
    kept = F.when(F.col("_alive").isNotNull(), F.col(child))
    return joined.withColumn(child, kept).drop("_alive").select(*jobs.columns)


def touch_last_run(
    profiles: DataFrame, runs: DataFrame, profile: str = "profile_id", time: str = "run_at"
) -> DataFrame:
    """Sets last_scraped_at to the latest run, where there was one."""
    last = runs.groupBy(F.col(profile).alias("id")).agg(F.max(time).alias("_run"))
    return (
        profiles.join(last, "id", "left")
        .withColumn("last_scraped_at", F.coalesce("_run", "last_scraped_at"))
        .select(*profiles.columns)
    )


def append_changes(changes: DataFrame, path: str, time: str = "changed_at") -> None:
    """Append-only audit rows, one folder per day; old rows are never rewritten."""
    (
        changes.withColumn("day", F.to_date(time))
        .write.mode("append").partitionBy("day").parquet(path)
    )
