"""Stored retention with what hangs on it, and the whole report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.operators.day_table import DayTable, drop_orphans, retain
from vacantia.operators.stored_table import StoredTable
from vacantia.plans.analytics import whole_report
from vacantia.schema import APPLICATIONS, COMPANIES, POSTINGS, PROFILES

NOW = dt.datetime(2026, 2, 20, 12)
JOBS = "job_id string, scraped_at timestamp_ntz, text string"


def jobs_of(spark, hours):
    rows = [(f"j{i}", None if h is None else NOW - dt.timedelta(hours=h), f"t{i}") for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, JOBS)


@pytest.fixture()
def stored(spark, tmp_path):
    jobs = jobs_of(spark, [1, 30, 47, 48, 49, 60, 100, 500, None])
    child = spark.createDataFrame([(f"j{i}", f"s{i}", i) for i in range(9)] + [("gone", "x", 1)], "job_id string, status string, n long")
    days = DayTable.open(spark, str(tmp_path / "jobs"), jobs.schema).add(jobs)
    return days, StoredTable.open(spark, str(tmp_path / "child"), child.schema, "job_id", 16).upsert(child, 0, "n"), tmp_path


def ids(df):
    return sorted(r.job_id for r in df.select("job_id").collect())


def test_old_days_go_and_children_follow(spark, stored):
    days, child, path = stored
    before = {str(f): f.stat().st_mtime_ns for f in (path / "jobs").rglob("*.parquet")}
    done = retain(days, [child], NOW, 48 * 3600)
    assert done.deleted == 4
    assert ids(done.jobs.read()) == ["j0", "j1", "j2", "j3", "j8"]  # exactly at the limit, and without a time, stay
    assert ids(done.children[0].read()) == ["gone", "j0", "j1", "j2", "j3", "j8"]
    # Only the border day is written anew; the other days keep their version.
    assert {d: v for d, v in done.jobs.days if v == 2} == {"2026-02-18": 2}
    now = {str(f): f.stat().st_mtime_ns for f in (path / "jobs").rglob("*.parquet")}
    assert before.items() <= now.items()
    assert DayTable.open(spark, days.path, days.schema).days == done.jobs.days
    assert ids(drop_orphans(done.jobs, done.children[0]).read()) == ["j0", "j1", "j2", "j3", "j8"]
    again = retain(done.jobs, done.children, NOW, 48 * 3600)
    assert again.deleted == 0 and again.jobs == done.jobs


def test_all_and_nothing(spark, stored, tmp_path):
    days, child, _ = stored
    assert retain(days, [child], NOW, 10**7).deleted == 0
    done = retain(days, [child], NOW + dt.timedelta(days=900), 1)
    assert done.deleted == 8 and ids(done.jobs.read()) == ["j8"] and ids(done.children[0].read()) == ["gone", "j8"]
    empty = DayTable.open(spark, str(tmp_path / "none"), days.schema)
    assert retain(empty, [child], NOW, 1).deleted == 0 and empty.read().count() == 0


def test_later_rows_join_their_day(spark, stored):
    days, _, _ = stored
    more = days.add(jobs_of(spark, [2, None]).withColumn("job_id", F.concat(F.lit("n"), "job_id")))
    assert len(ids(more.read())) == 11 and sum(v == 2 for _, v in more.days) == 2


def test_whole_report(spark):
    def fill(schema, rows):
        return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)

    def posting(i, company, hours, **more):
        return {"job_id": str(i), "title": "t", "company": company, "normalized_company_name": (company or "").lower() or None,
                "location": "SF", "scraped_at": NOW - dt.timedelta(hours=hours), "raw_description": "d", **more}

    jobs = fill(POSTINGS, [posting(1, "Acme", 1, profile_id=1), posting(2, "Acme", 30, profile_id=1), posting(3, "Bolt", 40 * 24),
                           posting(4, None, 3, location=None)])
    profiles = fill(PROFILES, [{"id": 1, "name": "p", "refresh_interval": 7200, "enabled": True, "last_scraped_at": NOW},
                               {"id": 2, "name": "q", "refresh_interval": 1800, "enabled": False}])
    applications = fill(APPLICATIONS, [{"job_id": "2", "status": "applied"}, {"job_id": "x", "status": "odd"}])
    size = spark.createDataFrame([(1.25,)], "size_mb double")
    got = {(r.section, r.entry, r.metric): r.value
           for r in whole_report(jobs, profiles, applications, fill(COMPANIES, []), NOW, size).collect()}
    assert got["jobs", "", "total"] == "4" and got["jobs.by_age", "", "stale"] == "1" and got["jobs.by_age", "", "fresh_24h"] == "2"
    assert got["jobs.by_application_status", "", "not_applied"] == "3" and got["applications", "", "total"] == "2"
    assert (got["jobs.top_companies", "1", "company"], got["jobs.top_companies", "1", "normalized_name"], got["jobs.top_companies", "1", "count"]) == ("Acme", "acme", "2")
    assert {got["jobs.top_locations", e, "location"] for e in "12"} == {"SF", None}
    assert got["scraping_profiles", "1", "total_jobs_cached"] == "2" and got["scraping_profiles", "2", "total_jobs_cached"] == "0"
    assert got["scraping_profiles", "1", "next_scrape_at"] == "2026-02-20T14:00:00" and got["scraping_profiles", "2", "next_scrape_at"] is None
    assert got["scraping_profiles", "2", "enabled"] == "false" and got["cache_health", "", "size_mb"] == "1.25"
    nothing = {(r.section, r.metric): r.value for r in whole_report(
        jobs.limit(0), profiles.limit(0), applications.limit(0), fill(COMPANIES, []), NOW).collect()}
    assert nothing["jobs", "total"] == "0" and nothing["jobs.by_age", "stale"] == "0" and nothing["cache_health", "oldest_job"] is None
