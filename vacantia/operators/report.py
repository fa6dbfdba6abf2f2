"""Aggregates over the stored tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.times import (
    days_before, hours_before, instant, seconds_after, seconds_to_hours,
)


def total(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("table"), "total")


def distinct_jobs(rows: DataFrame, key: str = "job_id", approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return rows.agg(counter.alias("jobs"))


def age_counts(
    jobs: DataFrame, as_of: Column | datetime | str, time: str = "scraped_at"
) -> DataFrame:
    """Cumulative freshness buckets and the exclusive stale rest, in one pass."""
    now, seen = instant(as_of), F.col(time)
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(seen >= hours_before(now, 24)).alias("fresh_24h"),
        F.count_if(seen >= days_before(now, 7)).alias("recent_7d"),
        F.count_if(seen >= days_before(now, 30)).alias("old_30d"),
        F.min(time).alias("oldest_job"),
        F.max(time).alias("newest_job"),
    ).withColumn("stale", F.col("total") - F.col("old_30d"))


def status_counts(
    applications: DataFrame, statuses: Iterable[str] = C.APPLICATION_STATUSES
) -> DataFrame:
    """One row per known status, zero when unused; unknown statuses are left out.

    One pass with a conditional count per status, then the single result row is turned into
    one row per status.
    """
    names = list(statuses)
    counts = applications.agg(*[
        F.count_if(F.col("status") == name).alias(f"_{i}") for i, name in enumerate(names)
    ])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("status"), F.col(f"_{i}").alias("jobs"))
        for i, name in enumerate(names)
    ])
    return counts.select(F.inline(pairs))


def not_applied(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Posting keys without an application."""
    return jobs.select("job_id").join(applications.select("job_id"), "job_id", "left_anti")


def jobs_by_status(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    open_jobs = not_applied(jobs, applications).agg(F.count(F.lit(1)).alias("jobs"))
    return open_jobs.select(F.lit(C.NOT_APPLIED).alias("status"), "jobs").unionByName(
        status_counts(applications)
    )


def top_companies(jobs: DataFrame, k: int = 10) -> DataFrame:
    """Most postings by normalised name; shown under the first spelling in text order."""
    return (
        jobs.groupBy("normalized_company_name")
        .agg(F.count(F.lit(1)).alias("jobs"), F.min("company").alias("company"))
        .orderBy(F.desc("jobs"), F.asc("normalized_company_name"))
        .limit(k)
    )


def top_locations(jobs: DataFrame, k: int = 10, column: str = "location") -> DataFrame:
    return (
        jobs.groupBy(column)
        .agg(F.count(F.lit(1)).alias("jobs"))
        .orderBy(F.desc("jobs"), F.asc(column))
        .limit(k)
    )


def jobs_per_profile(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """All profiles with their posting count; postings are counted before the join."""
    counts = (
        jobs.filter(F.col("profile_id").isNotNull())
        .groupBy(F.col("profile_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("total_jobs_cached"))
    )
    return profiles.join(counts, "id", "left").withColumn(
        "total_jobs_cached", F.coalesce("total_jobs_cached", F.lit(0).cast("bigint"))
    )


def profile_health(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    return profile_facts(jobs_per_profile(profiles, jobs))


def profile_facts(counted: DataFrame) -> DataFrame:
    """The report's columns of profiles that carry ``total_jobs_cached``."""
    return counted.select(
        F.col("id").alias("profile_id"),
        "name",
        "location",
        "distance",
        F.col("keywords").alias("query"),
        seconds_to_hours(F.col("refresh_interval")).alias("refresh_interval_hours"),
        "time_filter",
        F.col("enabled").cast("boolean").alias("enabled"),
        "last_scraped_at",
        seconds_after(F.col("last_scraped_at"), F.col("refresh_interval")).alias("next_scrape_at"),
        "total_jobs_cached",
        F.lit(0).cast("bigint").alias("error_count_24h"),
    )


def company_coverage(companies: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    return companies.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("next_refresh_at") < instant(as_of)).alias("needing_refresh"),
    )


def skill_counts(jobs: DataFrame, column: str = "skills") -> DataFrame:
    return (
        jobs.select(F.explode(column).alias("skill"))
        .groupBy("skill").agg(F.count(F.lit(1)).alias("jobs"))
    )


def skill_company_counts(jobs: DataFrame, column: str = "skills") -> DataFrame:
    return (
        jobs.select("normalized_company_name", F.explode(column).alias("skill"))
        .groupBy("skill", "normalized_company_name").agg(F.count(F.lit(1)).alias("jobs"))
    )
