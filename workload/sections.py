"""P: result sections and pages."""

from pyspark.sql import functions as F

from vacantia.operators import sections
from vacantia.plans.search import SearchFilters, envelope, matching, search_page, with_company
from workload.bindings import AS_OF, ctes, table, view
from workload.registry import query

_ISO = "'%Y-%m-%dT%H:%M:%S'"
_JOIN = ctes("jobs", "applications", "companies") + """
SELECT {columns} FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id
LEFT JOIN companies c ON j.normalized_company_name = c.normalized_company_name"""


def _found(spark, sf):
    """All postings with their application and company columns."""
    rows = matching(view(spark, sf, "jobs"), view(spark, sf, "applications"), SearchFilters(), AS_OF)
    return with_company(rows, view(spark, sf, "companies"))


def _section(spark, sf, name, lists=()):
    """One section, flattened; lists become joined text."""
    made = sections.with_sections(_found(spark, sf), [name]).select("job_id", f"{name}.*")
    return made.withColumns({c: F.array_join(c, "|") for c in lists}) if lists else made


@query("p1_wide_search_page", ctes("jobs", "applications", "companies") + f"""
SELECT j.job_id, j.title, j.company, j.location, j.posted_at, j.raw_description, j.salary,
  a.status AS application_status, a.applied_at, c.company_size, c.company_industry
FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id
LEFT JOIN companies c ON j.normalized_company_name = c.normalized_company_name
WHERE contains(j.normalized_company_name, 'src') AND contains(lower(j.location), 'e')
  AND j.posted_at >= TIMESTAMP '{AS_OF}' - to_hours(1000) AND a.job_id IS NULL
ORDER BY j.posted_at DESC NULLS LAST, j.job_id LIMIT 20 OFFSET 5""")
def _(spark, sf):
    wanted = SearchFilters(company="SRC, Inc.", location="E", posted_after_hours=1000,
                           application_status="not_applied")
    page = search_page(view(spark, sf, "jobs"), view(spark, sf, "applications"),
                       view(spark, sf, "companies"), wanted, AS_OF, limit=20, offset=5)
    return page.select(
        "job_id", "title", "company", "location", "posted_at", "raw_description", "salary",
        "application_status", "applied_at", "company_size", "company_industry")


@query("p2_core", ctes("jobs") + """
SELECT job_id, title, company, location, posted_date, posted_date_iso FROM jobs""")
def _(spark, sf):
    made = sections.with_sections(_found(spark, sf), []).select("core.*")
    return made


@query("p3_decision_making", ctes("jobs") + """
SELECT job_id, salary AS salary_range, remote_eligible, visa_sponsorship,
  number_of_applicants AS applicants, coalesce(easy_apply, false) AS easy_apply FROM jobs""")
def _(spark, sf):
    return _section(spark, sf, "decision_making")


@query("p4_description_insights", ctes("jobs") + """
SELECT job_id, description_summary, coalesce(array_to_string(key_requirements, '|'), '') AS key_requirements,
  key_responsibilities_preview FROM jobs""")
def _(spark, sf):
    return _section(spark, sf, "description_insights", ["key_requirements"])


@query("p5_application_tracking", _JOIN.format(columns=f"""
  j.job_id, a.status AS application_status, strftime(a.applied_at, {_ISO}) AS applied_at,
  a.notes AS application_notes"""))
def _(spark, sf):
    return _section(spark, sf, "application_tracking")


@query("p6_company_enrichment", _JOIN.format(columns="""
  j.job_id, c.company_size, c.company_industry, c.company_description, c.company_website,
  c.company_headquarters, c.company_founded,
  coalesce(array_to_string(c.company_specialties, '|'), '') AS company_specialties"""))
def _(spark, sf):
    return _section(spark, sf, "company_enrichment", ["company_specialties"])


@query("p7_metadata", ctes("jobs") + f"""
SELECT job_id, url AS job_url, strftime(scraped_at, {_ISO}) AS scraped_at,
  strftime(scraped_at, {_ISO}) AS last_seen, seniority_level, employment_type FROM jobs""")
def _(spark, sf):
    return _section(spark, sf, "metadata")


@query("p8_full_description", ctes("jobs") + "SELECT job_id, raw_description AS description FROM jobs")
def _(spark, sf):
    return _section(spark, sf, "full_description")


@query("p9_complete_skills", ctes("jobs") + """
SELECT job_id, coalesce(array_to_string(skills, '|'), '') AS skills_required, '' AS skills_preferred FROM jobs""")
def _(spark, sf):
    return _section(spark, sf, "complete_skills", ["skills_required", "skills_preferred"])


@query("p10_benefits", ctes("jobs") + "SELECT job_id, coalesce(benefits_badge, '') AS benefits FROM jobs")
def _(spark, sf):
    return _section(spark, sf, "benefits", ["benefits"])


@query("p11_employment_details", ctes("jobs") + """
SELECT job_id, CASE WHEN remote_eligible THEN 'Remote' ELSE 'On-site' END AS workplace_type,
  seniority_level AS experience_level, industries AS industry FROM jobs""")
def _(spark, sf):
    return _section(spark, sf, "employment_details")


@query("p12_composed_json")
def _(spark, sf):
    return sections.as_json(sections.with_sections(_found(spark, sf), sections.SECTIONS))


@query("p12_composed_sections", _JOIN.format(columns="""
  j.job_id, j.title, j.salary AS salary_range, a.status AS application_status, c.company_size,
  coalesce(array_to_string(j.skills, '|'), '') AS skills_required,
  CASE WHEN j.remote_eligible THEN 'Remote' ELSE 'On-site' END AS workplace_type"""))
def _(spark, sf):
    chosen = ["application_tracking", "company_enrichment", "complete_skills", "employment_details"]
    made = sections.with_sections(_found(spark, sf), chosen)
    return made.select(
        "job_id", "core.title", "decision_making.salary_range",
        "application_tracking.application_status", "company_enrichment.company_size",
        F.array_join("complete_skills.skills_required", "|").alias("skills_required"),
        "employment_details.workplace_type")


@query("p13_result_envelope", ctes("jobs", "applications") + """
SELECT greatest(least(count(*) - 40, 25), 0)::BIGINT AS returned, count(*) AS total, 25::BIGINT AS "limit"
FROM jobs j JOIN applications a ON j.job_id = a.job_id WHERE a.status = 'applied'""")
def _(spark, sf):
    return envelope(view(spark, sf, "jobs"), view(spark, sf, "applications"),
                    SearchFilters(application_status="applied"), AS_OF, limit=25, offset=40)


@query("p14_live_view", ctes("jobs") + f"""
SELECT job_id, title, nullif(salary, 'N/A') AS salary_range, substring(raw_description, 1, 500) AS description_summary,
  '' AS key_requirements, url AS job_url, strftime(scraped_at, {_ISO}) AS last_seen, raw_description AS description,
  CASE WHEN remote_eligible THEN 'Remote' END AS workplace_type, seniority_level AS experience_level, industries AS industry
FROM jobs""")
def _(spark, sf):
    made = sections.live_view(view(spark, sf, "jobs"))
    return made.select(
        "job_id", "core.title", "decision_making.salary_range", "description_insights.description_summary",
        F.array_join("description_insights.key_requirements", "|").alias("key_requirements"),
        "metadata.job_url", "metadata.last_seen", "full_description.description",
        "employment_details.workplace_type", "employment_details.experience_level",
        "employment_details.industry")
