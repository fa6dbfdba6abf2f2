"""The store report."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.times import days_before, hours_before, instant
from vacantia.operators import report
from vacantia.session import work_dir

_TIME = "yyyy-MM-dd'T'HH:mm:ss"


def _long(rows: DataFrame, figures: list[tuple[str, str, str]]) -> DataFrame:
    """A one-row aggregate → one row per (section, metric, column), from a single pass."""
    def text(name: str) -> Column:
        kind = rows.schema[name].dataType.typeName()
        column = F.date_format(name, _TIME) if kind.startswith("timestamp") else F.col(name)
        return column.cast("string")

    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                 text(name).alias("value"))
        for section, metric, name in figures
    ])))


def analytics_report(
    jobs: DataFrame,
    profiles: DataFrame,
    applications: DataFrame,
    companies: DataFrame,
    as_of: Column | datetime | str,
    size: DataFrame | None = None,
    top: int = 10,
) -> DataFrame:
    """Every figure of the report as (section, metric, value) rows.

    Each table is aggregated on its own and the small results are put under each other, so no
    result row waits for another. ``jobs`` is read with the few narrow columns it needs.
    """
    ages = report.age_counts(jobs, as_of)
    unapplied = report.not_applied(jobs, applications).agg(F.count(F.lit(1)).alias("jobs"))
    states = C.APPLICATION_STATUSES
    applied = applications.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in states],
    )
    coverage = report.company_coverage(companies, as_of)
    health = report.profile_health(profiles, jobs)
    companies_top = report.top_companies(jobs, top)
    locations_top = report.top_locations(jobs, top)

    def pairs(rows: DataFrame, section: str, metric: Column, value: Column) -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"),
            metric.cast("string").alias("metric"),
            value.cast("string").alias("value"),
        )

    parts = [
        _long(ages, [
            ("jobs", "total", "total"),
            *[("jobs.by_age", n, n) for n in ("fresh_24h", "recent_7d", "old_30d", "stale")],
            *[("cache_health", n, n) for n in ("oldest_job", "newest_job")],
        ]),
        _long(unapplied, [("jobs.by_application_status", C.NOT_APPLIED, "jobs")]),
        _long(applied, [
            ("applications", "total", "total"),
            *[("applications", s, s) for s in states],
            *[("jobs.by_application_status", s, s) for s in states],
        ]),
        pairs(companies_top, "jobs.top_companies", F.col("normalized_company_name"), F.col("jobs")),
        pairs(locations_top, "jobs.top_locations", F.col("location"), F.col("jobs")),
        pairs(health, "scraping_profiles", F.col("profile_id"), F.col("total_jobs_cached")),
        _long(coverage, [("company_enrichment", n, n) for n in ("total", "needing_refresh")]),
    ]
    if size is not None:
        parts.append(_long(size, [("cache_health", "size_mb", "size_mb")]))
    return reduce(DataFrame.unionByName, parts)


def _grouped_once(jobs: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    """One pass over the postings: counts of all, per company, per location and per profile.

    Grouping sets share the scan and are combined in the task that reads, so what is shuffled is a row
    per group and task. The few groups are written once, as every part of the report reads them.
    """
    now, seen = instant(as_of), F.col("scraped_at")
    sets = ["normalized_company_name", "location", "profile_id"]
    columns = [F.col(c) for c in sets]
    grouped = jobs.select(*sets, "company", "scraped_at").groupingSets([[], *[[c] for c in columns]], *columns).agg(
        F.grouping_id(*columns).alias("kind"),
        F.count(F.lit(1)).alias("jobs"), F.min("company").alias("company"),
        F.count_if(seen >= hours_before(now, 24)).alias("fresh_24h"),
        F.count_if(seen >= days_before(now, 7)).alias("recent_7d"),
        F.count_if(seen >= days_before(now, 30)).alias("old_30d"),
        F.min(seen).alias("oldest_job"), F.max(seen).alias("newest_job"),
    )
    path = work_dir(jobs.sparkSession, "report")
    grouped.write.parquet(path)
    return jobs.sparkSession.read.schema(grouped.schema).parquet(path)


#: grouping_id of the sets: a bit per column that was left out.
_ALL, _BY_COMPANY, _BY_LOCATION, _BY_PROFILE = 0b111, 0b011, 0b101, 0b110


def whole_report(
    jobs: DataFrame, profiles: DataFrame, applications: DataFrame, companies: DataFrame,
    as_of: Column | datetime | str, size: DataFrame | None = None, top: int = 10,
) -> DataFrame:
    """The report with every field of every entry, as ``(section, entry, metric, value)``.

    ``entry`` numbers the entries of a list (the rank of a company or location, the id of a profile) and is
    empty for single figures; NULL values stay NULL. The postings are read twice: once for all counts and
    ages, once by key for those without an application.
    """
    groups = _grouped_once(jobs, as_of)

    def told(rows: DataFrame, section: str, entry: Column, names: dict[str, Column]) -> DataFrame:
        def text(column: Column, name: str) -> Column:
            kind = rows.select(column.alias(name)).schema[name].dataType.typeName()
            return (F.date_format(column, _TIME) if kind.startswith("timestamp") else column).cast("string")

        return rows.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("section"), entry.cast("string").alias("entry"),
                     F.lit(name).alias("metric"), text(column, name).alias("value"))
            for name, column in names.items()
        ])))

    def single(rows: DataFrame, section: str, *names: str) -> DataFrame:
        return told(rows, section, F.lit(""), {n: F.col(n) for n in names})

    def ranked(kind: int, column: str) -> DataFrame:
        # The entries are ``top`` rows by then, so that numbering them is no work.
        best = groups.filter(F.col("kind") == kind).orderBy(F.desc("jobs"), F.asc(column)).limit(top)
        return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("jobs"), F.asc(column))))

    # One row, of zeros for an empty table: that has no group at all.
    counts = ["jobs", "fresh_24h", "recent_7d", "old_30d"]
    everything = groups.filter(F.col("kind") == _ALL).agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.max("oldest_job").alias("oldest_job"), F.max("newest_job").alias("newest_job"),
    ).withColumns({"total": F.col("jobs"), "stale": F.col("jobs") - F.col("old_30d")})
    states = C.APPLICATION_STATUSES
    applied = applications.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    open_jobs = report.not_applied(jobs, applications).agg(F.count(F.lit(1)).alias(C.NOT_APPLIED))
    counted = groups.filter((F.col("kind") == _BY_PROFILE) & F.col("profile_id").isNotNull()).select(
        F.col("profile_id").alias("id"), F.col("jobs").alias("_jobs"))
    health = report.profile_facts(profiles.join(counted, "id", "left").withColumn(
        "total_jobs_cached", F.coalesce("_jobs", F.lit(0).cast("bigint"))))
    firms, places = ranked(_BY_COMPANY, "normalized_company_name"), ranked(_BY_LOCATION, "location")
    parts = [
        single(everything, "jobs", "total"),
        single(everything, "jobs.by_age", "fresh_24h", "recent_7d", "old_30d", "stale"),
        single(open_jobs, "jobs.by_application_status", C.NOT_APPLIED),
        single(applied, "jobs.by_application_status", *states),
        told(firms, "jobs.top_companies", F.col("place"), {
            "company": F.col("company"), "normalized_name": F.col("normalized_company_name"), "count": F.col("jobs")}),
        told(places, "jobs.top_locations", F.col("place"), {"location": F.col("location"), "count": F.col("jobs")}),
        told(health, "scraping_profiles", F.col("profile_id"), {c: F.col(c) for c in health.columns}),
        single(applied, "applications", "total", *states),
        single(report.company_coverage(companies, as_of), "company_enrichment", "total", "needing_refresh"),
        single(everything, "cache_health", "oldest_job", "newest_job"),
    ]
    if size is not None:
        parts.append(single(size, "cache_health", "size_mb"))
    return reduce(DataFrame.unionByName, parts)


def nested_report(long_form: DataFrame, grouped: tuple[str, ...] = ("scraping_profiles",)) -> DataFrame:
    """The long form as one JSON object per section.

    Sections whose size grows with a table (one row per profile) stay in the long form.
    """
    fixed = long_form.filter(~F.col("section").isin(list(grouped)))
    return fixed.groupBy("section").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))))
        .alias("figures")
    )
