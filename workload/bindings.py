"""The posting tables, derived from the shared test tables in both engines.

Each view is one SELECT text; the few expressions that differ between the two SQL dialects
are filled in by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


AS_OF = "2024-01-31 00:00:00"

SPARK = {
    "as_of": f"TIMESTAMP_NTZ '{AS_OF}'",
    "hours": "make_dt_interval(0, CAST({0} AS INT))",
    "days": "make_dt_interval(CAST({0} AS INT))",
    "list2": "array({0}, {1})",
    "no_list": "CAST(NULL AS ARRAY<STRING>)",
    "no_time": "CAST(NULL AS TIMESTAMP_NTZ)",
}
DUCK = {
    "as_of": f"TIMESTAMP '{AS_OF}'",
    "hours": "to_hours(CAST({0} AS BIGINT))",
    "days": "to_days(CAST({0} AS INTEGER))",
    "list2": "[{0}, {1}]",
    "no_list": "CAST(NULL AS VARCHAR[])",
    "no_time": "CAST(NULL AS TIMESTAMP)",
}

_COMPANY = """
source || CASE doc_id % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Corp'
  WHEN 3 THEN ' Ltd.' WHEN 4 THEN '' ELSE ' Co.' END"""

_SALARY = """
CASE doc_id % 8 WHEN 0 THEN '$120K - $180K' WHEN 1 THEN '150000' WHEN 2 THEN '€60K - €80K'
  WHEN 3 THEN NULL WHEN 4 THEN 'N/A' WHEN 5 THEN '$150,000/yr + RSU'
  WHEN 6 THEN 'Competitive salary'
  ELSE '£' || CAST(40 + doc_id % 50 AS STRING) || 'K - £' || CAST(60 + doc_id % 90 AS STRING) || '.5k' END"""

# The normalised name is simply the lower-cased source for all suffixes above but ", Inc.",
# " Co." and the like, which the normaliser strips; the SQL side states the outcome directly.
_VIEWS = {
    "jobs": lambda d: f"""
SELECT CAST(doc_id AS STRING) AS job_id,
  split_part(text, chr(10), 1) AS title,
  {_COMPANY} AS company,
  lower(source) AS normalized_company_name,
  lang AS location,
  CAST(CAST(floor(((doc_id * 7) % 1440) / 24) AS BIGINT) AS STRING) || ' days ago' AS posted_date,
  CAST({d['as_of']} - {d['hours'].format('(doc_id * 7) % 1440')} AS STRING) AS posted_date_iso,
  {d['as_of']} - {d['hours'].format('(doc_id * 7) % 1440')} AS posted_at,
  {d['as_of']} - {d['hours'].format('(doc_id * 11) % 1000')} AS scraped_at,
  {_SALARY} AS salary,
  doc_id % 3 = 0 AS remote_eligible,
  doc_id % 4 = 1 AS visa_sponsorship,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 = 0 END AS easy_apply,
  CASE WHEN doc_id % 9 <> 0 THEN {d['list2'].format('lang', 'source')} ELSE {d['no_list']} END AS skills,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Over 200' WHEN 2 THEN '50-100'
    WHEN 3 THEN CAST(doc_id AS STRING) || ' applicants' ELSE '7' END AS number_of_applicants,
  substring(text, 1, 120) AS description_summary,
  CASE WHEN doc_id % 4 <> 0 THEN {d['list2'].format("'5+ years experience'", 'lang')} ELSE {d['no_list']} END AS key_requirements,
  CASE WHEN doc_id % 6 = 0 THEN substring(text, 1, 20) END AS key_responsibilities_preview,
  text AS raw_description,
  CASE doc_id % 3 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Contract' END AS employment_type,
  CASE doc_id % 4 WHEN 0 THEN 'Entry level' WHEN 1 THEN 'Senior' END AS seniority_level,
  'Engineering' AS job_function,
  CASE WHEN doc_id % 2 = 0 THEN 'Technology' END AS industries,
  CASE doc_id % 5 WHEN 0 THEN 'Actively Hiring' WHEN 1 THEN '' END AS benefits_badge,
  'https://jobs.example.com/' || CAST(doc_id AS STRING) AS url,
  source,
  CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 37) % 2000 END AS profile_id
FROM documents""",
    "applications": lambda d: f"""
SELECT CAST(doc_id AS STRING) AS job_id,
  {d['as_of']} - {d['hours'].format('(doc_id * 5) % 700')} AS applied_at,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'applied' WHEN quality = 1 THEN 'interviewing'
    WHEN toxic = 0 THEN 'rejected' ELSE 'offered' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN 'note ' || CAST(doc_id AS STRING) ELSE '' END AS notes,
  {d['as_of']} - {d['hours'].format('(doc_id * 5) % 700')} AS created_at,
  {d['as_of']} AS updated_at
FROM labels""",
    "companies": lambda d: f"""
SELECT 'SRC' || CAST(s_suppkey + 5 AS STRING) || ' Inc.' AS company_name,
  'src' || CAST(s_suppkey + 5 AS STRING) AS normalized_company_name,
  CAST(s_nationkey AS STRING) AS company_size,
  s_name AS company_industry,
  CAST(NULL AS STRING) AS company_description,
  'https://example.com/' || CAST(s_suppkey AS STRING) AS company_website,
  'HQ ' || CAST(s_nationkey AS STRING) AS company_headquarters,
  CAST(1950 + s_suppkey % 70 AS INT) AS company_founded,
  CASE WHEN s_suppkey % 4 = 0 THEN {d['list2'].format("'a'", 's_name')} ELSE {d['no_list']} END AS company_specialties,
  {d['as_of']} - {d['days'].format('(s_suppkey * 13) % 75')} AS scraped_at,
  {d['as_of']} - {d['days'].format('(s_suppkey * 13) % 75 - 30')} AS next_refresh_at
FROM supplier""",
    "profiles": lambda d: f"""
SELECT c_custkey AS id,
  c_name AS name,
  c_mktsegment AS location,
  'kw' || CAST(c_nationkey AS STRING) AS keywords,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 30 ELSE 50 END AS INT) AS distance,
  'r86400' AS time_filter,
  CAST(1800 * (1 + c_nationkey % 9) AS INT) AS refresh_interval,
  c_custkey % 3 <> 0 AS enabled,
  CASE WHEN c_custkey % 5 <> 0 THEN {d['as_of']} - {d['hours'].format('c_custkey % 13')} ELSE {d['no_time']} END AS last_scraped_at,
  {d['as_of']} - {d['hours'].format('c_custkey % 97')} AS created_at
FROM customer""",
    "snapshots": lambda d: """
SELECT CAST(user_id AS STRING) AS job_id, ts AS scraped_at, event_id, event_type,
  CAST(CAST(floor(value / 10) AS BIGINT) AS STRING) AS value_band, props
FROM events""",
}

_SOURCES = {
    "jobs": "documents", "applications": "labels", "companies": "supplier",
    "profiles": "customer", "snapshots": "events",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source = _SOURCES[name]
    text = _VIEWS[name](SPARK)
    marker = f"FROM {source}"
    return spark.sql(
        text.replace(marker, f"FROM {{{source}}}"), **{source: table(spark, sf, source)}
    )


def ctes(*names: str) -> str:
    """WITH clause for the named views."""
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n](DUCK)})" for n in names)


# Helper views for the SQL side.
TOKENS = r"""
words AS (
  SELECT job_id, field, list_filter(
    string_split_regex(strip_accents(lower(body)), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w
  FROM (SELECT job_id, 'title' AS field, title AS body FROM jobs
    UNION ALL SELECT job_id, 'company', company FROM jobs
    UNION ALL SELECT job_id, 'raw_description', raw_description FROM jobs
    UNION ALL SELECT job_id, 'skills', array_to_string(skills, ' ') FROM jobs)
),
tok AS (
  SELECT job_id, field, unnest(w) AS token, unnest(range(len(w))) AS pos FROM words
)"""


def with_tokens() -> str:
    return ctes("jobs") + "," + TOKENS


def norm_sql(expr: str) -> str:
    """The company rule in DuckDB SQL."""
    suffixes = (
        r", inc\.| inc\.| inc|, llc| llc|, ltd\.| ltd\.| ltd|, corp\.| corp\.| corp"
        r"|, corporation| corporation| limited|, co\.| co\."
    )
    return f"trim(regexp_replace(lower(trim({expr})), '({suffixes})$', ''))"
