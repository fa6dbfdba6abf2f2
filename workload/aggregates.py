"""A: counts, buckets, tops and the whole report."""

from pyspark.sql import functions as F

from vacantia.operators import report
from vacantia.plans import analytics
from vacantia.plans.search import SearchFilters, count_matches, envelope, matching
from workload.bindings import AS_OF, ctes, table, view
from workload.registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
ALL = ("jobs", "profiles", "applications", "companies")
STATUSES = "(VALUES ('applied'), ('interviewing'), ('rejected'), ('offered'), ('accepted')) s(status)"


def _views(spark, sf, names=ALL):
    return [view(spark, sf, n) for n in names]


@query("a1_table_totals", ctes(*ALL) + """
SELECT 'jobs' AS "table", count(*) AS total FROM jobs
UNION ALL SELECT 'profiles', count(*) FROM profiles
UNION ALL SELECT 'applications', count(*) FROM applications
UNION ALL SELECT 'companies', count(*) FROM companies""")
def _(spark, sf):
    parts = [report.total(view(spark, sf, name), name) for name in ALL]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a2_distinct_matching_jobs", ctes("jobs", "applications") + """
SELECT count(DISTINCT j.job_id) AS total FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id
WHERE j.remote_eligible AND a.status = 'applied'""")
def _(spark, sf):
    wanted = SearchFilters(remote_only=True, application_status="applied")
    return count_matches(*_views(spark, sf, ("jobs", "applications")), wanted, AS_OF)


@query("a2_distinct_keys", "SELECT count(DISTINCT l_orderkey) AS jobs FROM lineitem")
def _(spark, sf):
    return report.distinct_jobs(table(spark, sf, "lineitem"), "l_orderkey")


@query("a3_age_buckets", ctes("jobs") + f"""
SELECT count(*) AS total, count(*) FILTER (scraped_at >= {NOW} - to_hours(24)) AS fresh_24h,
  count(*) FILTER (scraped_at >= {NOW} - to_days(7)) AS recent_7d,
  count(*) FILTER (scraped_at >= {NOW} - to_days(30)) AS old_30d,
  count(*) - count(*) FILTER (scraped_at >= {NOW} - to_days(30)) AS stale,
  min(scraped_at) AS oldest_job, max(scraped_at) AS newest_job FROM jobs""")
def _(spark, sf):
    return report.age_counts(view(spark, sf, "jobs"), AS_OF)


@query("a4_status_counts", ctes("applications") + f"""
SELECT s.status, count(a.job_id) AS jobs FROM {STATUSES} LEFT JOIN applications a ON a.status = s.status
GROUP BY s.status""")
def _(spark, sf):
    return report.status_counts(view(spark, sf, "applications"))


@query("a5_jobs_by_status", ctes("jobs", "applications") + f"""
SELECT s.status, count(a.job_id) AS jobs FROM {STATUSES} LEFT JOIN applications a ON a.status = s.status
GROUP BY s.status
UNION ALL SELECT 'not_applied', count(*) FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id
WHERE a.job_id IS NULL""")
def _(spark, sf):
    return report.jobs_by_status(*_views(spark, sf, ("jobs", "applications")))


@query("a6_top_companies", ctes("jobs") + """
SELECT normalized_company_name, min(company) AS company, count(*) AS jobs FROM jobs
GROUP BY normalized_company_name ORDER BY jobs DESC, normalized_company_name LIMIT 10""")
def _(spark, sf):
    return report.top_companies(view(spark, sf, "jobs"))


@query("a7_top_locations", ctes("jobs") + """
SELECT location, count(*) AS jobs FROM jobs GROUP BY location ORDER BY jobs DESC, location LIMIT 10""")
def _(spark, sf):
    return report.top_locations(view(spark, sf, "jobs"))


@query("a8_jobs_per_profile", ctes("profiles", "jobs") + """
SELECT p.id, count(j.job_id) AS total_jobs_cached FROM profiles p LEFT JOIN jobs j ON j.profile_id = p.id
GROUP BY p.id""")
def _(spark, sf):
    return report.jobs_per_profile(*_views(spark, sf, ("profiles", "jobs"))).select(
        "id", "total_jobs_cached")


@query("a9_profile_health", ctes("profiles", "jobs") + """
SELECT id AS profile_id, name, location, distance, keywords AS query,
  refresh_interval / 3600.0::DOUBLE AS refresh_interval_hours, time_filter, enabled, last_scraped_at,
  last_scraped_at + to_seconds(refresh_interval) AS next_scrape_at,
  (SELECT count(*) FROM jobs j WHERE j.profile_id = p.id) AS total_jobs_cached,
  0::BIGINT AS error_count_24h FROM profiles p""")
def _(spark, sf):
    return report.profile_health(*_views(spark, sf, ("profiles", "jobs")))


@query("a10_company_coverage", ctes("companies") + f"""
SELECT count(*) AS total, count(*) FILTER (next_refresh_at < {NOW}) AS needing_refresh FROM companies""")
def _(spark, sf):
    return report.company_coverage(view(spark, sf, "companies"), AS_OF)


@query("a11_oldest_newest", "SELECT min(ts) AS oldest_job, max(ts) AS newest_job FROM events")
def _(spark, sf):
    return report.age_counts(table(spark, sf, "events"), AS_OF, "ts").select("oldest_job", "newest_job")


_TIME = "'%Y-%m-%dT%H:%M:%S'"
_REPORT_SQL = ctes(*ALL) + f""",
ages AS (SELECT count(*) AS total, count(*) FILTER (scraped_at >= {NOW} - to_hours(24)) AS d1,
  count(*) FILTER (scraped_at >= {NOW} - to_days(7)) AS d7,
  count(*) FILTER (scraped_at >= {NOW} - to_days(30)) AS d30,
  min(scraped_at) AS lo, max(scraped_at) AS hi FROM jobs),
states AS (SELECT s.status, count(a.job_id) AS n FROM {STATUSES}
  LEFT JOIN applications a ON a.status = s.status GROUP BY s.status),
report AS (
SELECT 'jobs' AS section, 'total' AS metric, CAST(total AS VARCHAR) AS value FROM ages
UNION ALL SELECT 'jobs.by_age', 'fresh_24h', CAST(d1 AS VARCHAR) FROM ages
UNION ALL SELECT 'jobs.by_age', 'recent_7d', CAST(d7 AS VARCHAR) FROM ages
UNION ALL SELECT 'jobs.by_age', 'old_30d', CAST(d30 AS VARCHAR) FROM ages
UNION ALL SELECT 'jobs.by_age', 'stale', CAST(total - d30 AS VARCHAR) FROM ages
UNION ALL SELECT 'jobs.by_application_status', status, CAST(n AS VARCHAR) FROM states
UNION ALL SELECT 'jobs.by_application_status', 'not_applied', CAST(count(*) AS VARCHAR) FROM jobs
  WHERE job_id NOT IN (SELECT job_id FROM applications)
UNION ALL (SELECT 'jobs.top_companies', normalized_company_name, CAST(count(*) AS VARCHAR) FROM jobs
  GROUP BY normalized_company_name ORDER BY count(*) DESC, normalized_company_name LIMIT 10)
UNION ALL (SELECT 'jobs.top_locations', location, CAST(count(*) AS VARCHAR) FROM jobs
  GROUP BY location ORDER BY count(*) DESC, location LIMIT 10)
UNION ALL SELECT 'scraping_profiles', CAST(p.id AS VARCHAR), CAST(count(j.job_id) AS VARCHAR)
  FROM profiles p LEFT JOIN jobs j ON j.profile_id = p.id GROUP BY p.id
UNION ALL SELECT 'applications', 'total', CAST(count(*) AS VARCHAR) FROM applications
UNION ALL SELECT 'applications', status, CAST(n AS VARCHAR) FROM states
UNION ALL SELECT 'company_enrichment', 'total', CAST(count(*) AS VARCHAR) FROM companies
UNION ALL SELECT 'company_enrichment', 'needing_refresh',
  CAST(count(*) FILTER (next_refresh_at < {NOW}) AS VARCHAR) FROM companies
UNION ALL SELECT 'cache_health', 'oldest_job', strftime(lo, {_TIME}) FROM ages
UNION ALL SELECT 'cache_health', 'newest_job', strftime(hi, {_TIME}) FROM ages)
"""


def _report(spark, sf):
    return analytics.analytics_report(*_views(spark, sf), AS_OF)


@query("a13_store_report", _REPORT_SQL + "SELECT section, metric, value FROM report")
def _(spark, sf):
    return _report(spark, sf)


_FIRMS = """
  SELECT normalized_company_name AS n, min(company) AS c, count(*) AS k,
    row_number() OVER (ORDER BY count(*) DESC, normalized_company_name) AS place
  FROM jobs GROUP BY 1 QUALIFY place <= 10"""
_PLACES = """
  SELECT location AS n, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, location) AS place
  FROM jobs GROUP BY 1 QUALIFY place <= 10"""


@query("a13_whole_report", _REPORT_SQL + f""", firms AS ({_FIRMS}), places AS ({_PLACES}), health AS (
  SELECT p.*, count(j.job_id) AS k FROM profiles p LEFT JOIN jobs j ON j.profile_id = p.id GROUP BY ALL
)
SELECT section, '' AS entry, metric, value FROM report
WHERE section NOT IN ('jobs.top_companies', 'jobs.top_locations', 'scraping_profiles')
UNION ALL SELECT 'jobs.top_companies', CAST(place AS VARCHAR), m, v FROM firms,
  (VALUES (1, 'company'), (2, 'normalized_name'), (3, 'count')) x(i, m),
  LATERAL (SELECT [c, n, CAST(k AS VARCHAR)][i] AS v)
UNION ALL SELECT 'jobs.top_locations', CAST(place AS VARCHAR), m, v FROM places,
  (VALUES (1, 'location'), (2, 'count')) x(i, m), LATERAL (SELECT [n, CAST(k AS VARCHAR)][i] AS v)
UNION ALL SELECT 'scraping_profiles', CAST(id AS VARCHAR), m, v FROM health,
  (VALUES (1, 'profile_id'), (2, 'name'), (3, 'location'), (4, 'distance'), (5, 'query'), (6, 'refresh_interval_hours'),
    (7, 'time_filter'), (8, 'enabled'), (9, 'last_scraped_at'), (10, 'next_scrape_at'), (11, 'total_jobs_cached'),
    (12, 'error_count_24h')) x(i, m),
  LATERAL (SELECT [CAST(id AS VARCHAR), name, location, CAST(distance AS VARCHAR), keywords,
    CAST(refresh_interval / 3600 AS VARCHAR), time_filter, CAST(enabled AS VARCHAR), strftime(last_scraped_at, {_TIME}),
    strftime(last_scraped_at + to_seconds(refresh_interval), {_TIME}), CAST(k AS VARCHAR), '0'][i] AS v)
""")
def _(spark, sf):
    return analytics.whole_report(*_views(spark, sf), AS_OF)


@query("a13_store_report_nested", _REPORT_SQL + """
SELECT section, '{' || string_agg('"' || metric || '":"' || value || '"', ',' ORDER BY metric) || '}' AS figures
FROM report WHERE section <> 'scraping_profiles' GROUP BY section""")
def _(spark, sf):
    return analytics.nested_report(_report(spark, sf))


@query("a14_found_and_returned", ctes("jobs", "applications") + """
SELECT least(count(*), 20)::BIGINT AS returned, count(*) AS total, 20::BIGINT AS "limit"
FROM jobs WHERE visa_sponsorship AND contains(location, 'en')""")
def _(spark, sf):
    wanted = SearchFilters(visa_sponsorship=True, location="EN")
    return envelope(*_views(spark, sf, ("jobs", "applications")), wanted, AS_OF, 20)
