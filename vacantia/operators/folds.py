"""Replays of event histories into current rows.

Both folds are aggregates over (order, value) pairs. Nothing is sorted or collected per key,
partial results are combined before the shuffle, so a hot key is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.operators.lookup import lookup


def _last(value: Column, order: Column, where: Column) -> Column:
    """Value at the greatest order among the rows that satisfy ``where``."""
    return F.max_by(F.struct(value.alias("v")), F.when(where, order))["v"]


def fold_applications(
    events: DataFrame, jobs: DataFrame, time: str = "ts", tie_break: Sequence[str] = ()
) -> DataFrame:
    """Events (job_id, action, status, notes) → one application per job.

    ``apply`` on an unknown job and ``status`` before any ``apply`` have no effect. The first
    apply sets created_at, the last one applied_at; the last event sets status and notes, an
    omitted note becoming the empty string. Unknown jobs are dropped after the fold, when each
    job is one row.
    """
    order = F.struct(time, *tie_break)
    applies = F.col("action") == "apply"
    status = F.when(applies, F.lit("applied")).otherwise(F.col("status"))
    folded = (
        events.groupBy("job_id")
        .agg(
            F.max(F.when(applies, F.col(time))).alias("applied_at"),
            F.max_by(status, order).alias("status"),
            F.max_by(F.coalesce("notes", F.lit("")), order).alias("notes"),
            F.min(F.when(applies, F.col(time))).alias("created_at"),
            F.max(time).alias("updated_at"),
        )
        .filter(F.col("created_at").isNotNull())
    )
    return folded.join(jobs.select("job_id"), "job_id", "left_semi")


def rejected_application_events(
    events: DataFrame, jobs: DataFrame, time: str = "ts", tie_break: Sequence[str] = ()
) -> DataFrame:
    """The events :func:`fold_applications` ignores, with the reason."""
    spread = [time, *tie_break]
    order = F.struct(time, *tie_break)
    first = events.groupBy("job_id").agg(
        F.min(F.when(F.col("action") == "apply", order)).alias("_first")
    )
    known = jobs.select("job_id", F.lit(True).alias("_known"))
    facts = first.join(known, "job_id", "left")
    joined = lookup(events, facts, "job_id", "left", spread_by=spread)
    reason = F.when(F.col("_known").isNull(), "unknown job").when(
        F.col("_first").isNull() | (order < F.col("_first")), "no application"
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop(
        "_first", "_known"
    )


def fold_profiles(
    events: DataFrame,
    key: str = "name",
    time: str = "ts",
    tie_break: Sequence[str] = (),
    defaults: dict = C.PROFILE_DEFAULTS,
) -> DataFrame:
    """Profile events (action add/update/disable/delete plus columns) → surviving profiles.

    ``add`` creates or resets a profile, omitted options falling back to the defaults;
    ``update`` changes the given columns only; ``disable`` clears enabled; ``delete`` removes
    the profile. Events on a profile that does not exist have no effect.
    """
    settings = ["location", "keywords", "distance", "time_filter", "refresh_interval", "enabled"]
    order = F.struct(time, *tie_break)
    action = F.col("action")
    marks = events.groupBy(key).agg(
        F.max(F.when(action == "delete", order)).alias("_deleted"),
        F.max(F.when(action == "add", order)).alias("_reset"),
    )
    alive = marks.filter(
        F.col("_reset").isNotNull()
        & (F.col("_deleted").isNull() | (F.col("_reset") > F.col("_deleted")))
    )
    current = lookup(events, alive, key, "inner", spread_by=[time, *tie_break])
    after_delete = F.col("_deleted").isNull() | (order > F.col("_deleted"))
    in_force = order >= F.col("_reset")

    def setting(name: str) -> Column:
        value = F.col(name)
        if name in defaults:
            value = F.when(action == "add", F.coalesce(value, F.lit(defaults[name]))).otherwise(value)
        if name == "enabled":
            value = F.when(action == "disable", F.lit(False)).otherwise(value)
        return _last(value, order, in_force & value.isNotNull()).alias(name)

    created = F.min(F.when((action == "add") & after_delete, F.col(time)))
    return current.groupBy(key).agg(
        *[setting(name) for name in settings],
        created.alias("created_at"),
        F.max(time).alias("updated_at"),
    )
