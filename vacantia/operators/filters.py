"""Predicates and row validation."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import normalize_company, present_text
from vacantia.functions.times import hours_before, instant, seconds_after


def company_is(argument: str) -> Column:
    return F.contains(F.col("normalized_company_name"), normalize_company(F.lit(argument)))


def located_in(argument: str, column: str = "location") -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(argument)))


def posted_within(hours: int, as_of: Column | datetime | str, column: str = "posted_at") -> Column:
    return F.col(column) >= hours_before(instant(as_of), hours)


def flagged(column: str) -> Column:
    """True flags only; works for booleans and for 0/1 integers."""
    return F.col(column).cast("boolean")


def enabled_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.filter(flagged("enabled"))


def needs_refresh(companies: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    return companies.filter(F.col("next_refresh_at") < instant(as_of))


def due_profiles(profiles: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    """Enabled or not is the caller's filter; due means never run or interval elapsed."""
    next_run = seconds_after(F.col("last_scraped_at"), F.col("refresh_interval"))
    return profiles.filter(F.col("last_scraped_at").isNull() | (next_run <= instant(as_of)))


def company_lookup(companies: DataFrame, names: DataFrame, column: str = "company") -> DataFrame:
    """Company facts for many names at once, whatever their spelling or legal suffix."""
    keys = names.select(normalize_company(F.col(column)).alias("normalized_company_name"))
    return key_lookup(companies, keys, "normalized_company_name")


def key_lookup(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of many requested keys at once. Repeated requests give one row."""
    return table.join(keys.select(on), on, "left_semi")


def passes_gate(required: Iterable[str] = ("job_id", "title", "company")) -> Column:
    ok = F.lit(True)
    for name in required:
        ok = ok & present_text(F.col(name)).isNotNull()
    return ok


def quality_gate(
    rows: DataFrame,
    required: Iterable[str] = ("job_id", "title", "company"),
    counts: Observation | None = None,
) -> DataFrame:
    """Drops rows whose scrape failed, so they never overwrite good data.

    ``counts`` receives the rows seen and skipped from the pass that uses the result.
    """
    if counts is not None:
        rows = rows.observe(
            counts,
            F.count(F.lit(1)).alias("seen"),
            F.count_if(~passes_gate(required)).alias("skipped"),
        )
    return rows.filter(passes_gate(required))


def gate_counts(rows: DataFrame, required=("job_id", "title", "company")) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(passes_gate(required)).alias("passed"),
        F.count_if(~passes_gate(required)).alias("skipped"),
    )


def _first_reason(rules: list[tuple[Column, str]]) -> Column:
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(broken, text).otherwise(reason)
    return reason


def check_profiles(
    profiles: DataFrame,
    distances: Iterable[int] = C.PROFILE_DISTANCES,
    min_interval: int = C.MIN_REFRESH_SECONDS,
) -> DataFrame:
    """Adds reject_reason, NULL for valid rows. Omitted settings are valid."""
    return profiles.withColumn("reject_reason", _first_reason([
        (~F.col("distance").isin(list(distances)), "invalid distance"),
        (F.col("refresh_interval") < min_interval, "refresh_interval too short"),
    ]))


def check_status_events(
    events: DataFrame, column: str = "status", statuses: Iterable[str] = C.APPLICATION_STATUSES
) -> DataFrame:
    """Adds reject_reason for a status outside the domain."""
    allowed = F.coalesce(F.col(column).isin(list(statuses)), F.lit(False))
    return events.withColumn("reject_reason", _first_reason([(~allowed, "invalid status")]))
