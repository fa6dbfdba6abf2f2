"""F: predicates, lookups, gates."""

from pyspark.sql import functions as F

from vacantia.functions.times import instant, seconds_after
from vacantia.operators import filters
from vacantia.operators.changes import change_log, recent_changes
from vacantia.plans.search import SearchFilters, matching
from workload.bindings import AS_OF, ctes, table, view
from workload.registry import query

NOW = f"TIMESTAMP '{AS_OF}'"


@query("f1_company_contains", ctes("jobs") + """
SELECT job_id, company FROM jobs WHERE contains(normalized_company_name, 'src1')""")
def _(spark, sf):
    return view(spark, sf, "jobs").filter(filters.company_is("SRC1 Corp.")).select("job_id", "company")


@query("f2_location_contains", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')""")
def _(spark, sf):
    return table(spark, sf, "part").filter(filters.located_in("ReD", "p_name")).select(
        "p_partkey", "p_name")


@query("f10_posted_within_hours", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - to_hours(8760)""")
def _(spark, sf):
    recent = filters.posted_within(8760, "2001-08-01 00:00:00", "o_orderdate")
    return table(spark, sf, "orders").filter(recent).select("o_orderkey", "o_orderdate")


@query("f11_remote_only", ctes("jobs") + """
SELECT job_id FROM jobs WHERE remote_eligible""")
def _(spark, sf):
    return view(spark, sf, "jobs").filter(filters.flagged("remote_eligible")).select("job_id")


@query("f12_visa_only", "SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, sf):
    return table(spark, sf, "labels").filter(filters.flagged("toxic")).select("doc_id")


@query("f13_application_status", ctes("jobs", "applications") + """
SELECT j.job_id, a.status AS application_status, a.applied_at
FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id WHERE a.status = 'interviewing'""")
def _(spark, sf):
    wanted = SearchFilters(application_status="interviewing")
    return matching(view(spark, sf, "jobs"), view(spark, sf, "applications"), wanted, AS_OF).select(
        "job_id", "application_status", "applied_at")


@query("f14_not_applied", ctes("jobs", "applications") + """
SELECT j.job_id FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id
WHERE a.job_id IS NULL""")
def _(spark, sf):
    wanted = SearchFilters(application_status="not_applied")
    return matching(view(spark, sf, "jobs"), view(spark, sf, "applications"), wanted, AS_OF).select(
        "job_id")


@query("f15_all_filters", ctes("jobs", "applications") + f"""
SELECT j.job_id, a.status AS application_status
FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id
WHERE contains(j.normalized_company_name, 'src') AND contains(lower(j.location), 'e')
  AND j.posted_at >= {NOW} - to_hours(1200) AND j.remote_eligible AND j.visa_sponsorship
  AND list_contains(string_split_regex(strip_accents(lower(j.raw_description)), '[^\\p{{L}}\\p{{N}}]+'), 'the')
  AND a.status = 'applied'""")
def _(spark, sf):
    wanted = SearchFilters(
        company="Src", location="E", keywords="raw_description:the", posted_after_hours=1200,
        remote_only=True, visa_sponsorship=True, application_status="applied")
    return matching(view(spark, sf, "jobs"), view(spark, sf, "applications"), wanted, AS_OF).select(
        "job_id", "application_status")


@query("f15_no_filter", ctes("jobs", "applications") + """
SELECT j.job_id, a.status AS application_status
FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id""")
def _(spark, sf):
    wanted = SearchFilters(company="", posted_after_hours=0)
    return matching(view(spark, sf, "jobs"), view(spark, sf, "applications"), wanted, AS_OF).select(
        "job_id", "application_status")


@query("f16_key_lookup", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, sf):
    keys = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey"))
    return filters.key_lookup(table(spark, sf, "customer"), keys, "c_custkey").select(
        "c_custkey", "c_name")


@query("f16_company_lookup", ctes("companies") + """
SELECT normalized_company_name, company_size FROM companies
WHERE normalized_company_name IN (SELECT lower(source) FROM documents)""")
def _(spark, sf):
    names = view(spark, sf, "jobs").select("company")
    return filters.company_lookup(view(spark, sf, "companies"), names).select(
        "normalized_company_name", "company_size")


@query("f17_enabled_profiles", ctes("profiles") + "SELECT id, name FROM profiles WHERE enabled")
def _(spark, sf):
    return filters.enabled_profiles(view(spark, sf, "profiles")).select("id", "name")


@query("f18_companies_needing_refresh", ctes("companies") + f"""
SELECT company_name, next_refresh_at FROM companies WHERE next_refresh_at < {NOW}""")
def _(spark, sf):
    return filters.needs_refresh(view(spark, sf, "companies"), AS_OF).select(
        "company_name", "next_refresh_at")


@query("f19_due_profiles", ctes("profiles") + f"""
SELECT id, last_scraped_at FROM profiles
WHERE last_scraped_at IS NULL OR last_scraped_at + to_seconds(refresh_interval) <= {NOW}""")
def _(spark, sf):
    return filters.due_profiles(view(spark, sf, "profiles"), AS_OF).select("id", "last_scraped_at")


_GATED = """
SELECT CAST(doc_id AS VARCHAR) AS job_id,
  CASE WHEN doc_id % 9 = 0 THEN 'N/A' ELSE substring(text, 1, 30) END AS title,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE source END AS company FROM documents"""


def _scraped(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.when(F.col("doc_id") % 9 == 0, "N/A").otherwise(F.substring("text", 1, 30)).alias("title"),
        F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("company"),
    )


@query("f20_quality_gate", f"""
SELECT * FROM ({_GATED}) WHERE title <> 'N/A' AND title <> '' AND company IS NOT NULL""")
def _(spark, sf):
    return filters.quality_gate(_scraped(spark, sf))


@query("f20_gate_counts", f"""
SELECT count(*) AS seen,
  count(*) FILTER (title <> 'N/A' AND title <> '' AND company IS NOT NULL) AS passed,
  count(*) - count(*) FILTER (title <> 'N/A' AND title <> '' AND company IS NOT NULL) AS skipped
FROM ({_GATED})""")
def _(spark, sf):
    return filters.gate_counts(_scraped(spark, sf))


@query("f21_recent_changes", ctes("jobs", "snapshots") + """,
steps AS (
  SELECT job_id, scraped_at, event_type,
    lag(event_type) OVER w AS old_value, row_number() OVER w AS n
  FROM snapshots WINDOW w AS (PARTITION BY job_id ORDER BY scraped_at, event_id)
)
SELECT s.job_id, s.scraped_at AS changed_at, 'event_type' AS field_name, s.old_value,
  s.event_type AS new_value, j.title, j.company
FROM steps s JOIN jobs j ON s.job_id = j.job_id
WHERE s.n > 1 AND s.old_value IS DISTINCT FROM s.event_type
  AND s.scraped_at >= TIMESTAMP '2024-01-30 00:00:00' - to_hours(72)""")
def _(spark, sf):
    log = change_log(view(spark, sf, "snapshots"), fields=["event_type"], tie_break=["event_id"])
    return recent_changes(log, view(spark, sf, "jobs"), "2024-01-30 00:00:00", 72).select(
        "job_id", "changed_at", "field_name", "old_value", "new_value", "title", "company")


@query("f22_profile_validation", ctes("profiles") + """
SELECT id, CASE WHEN distance NOT IN (10, 25, 35, 50, 75, 100) THEN 'invalid distance'
  WHEN refresh_interval < 3600 THEN 'refresh_interval too short' END AS reject_reason
FROM profiles""")
def _(spark, sf):
    return filters.check_profiles(view(spark, sf, "profiles")).select("id", "reject_reason")


@query("f22_status_validation", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN NULL
  ELSE 'invalid status' END AS reject_reason FROM events""")
def _(spark, sf):
    checked = filters.check_status_events(
        table(spark, sf, "events"), "event_type", ["view", "click", "purchase"])
    return checked.select("event_id", "reject_reason")
