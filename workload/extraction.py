"""Whole enrichment job over raw text: every derived posting column at once."""

from pyspark.sql import functions as F

from vacantia.plans.ingest import enrich
from workload.bindings import AS_OF, norm_sql, table
from workload.registry import query


@query("x_enrich_postings", rf"""
SELECT CAST(doc_id AS VARCHAR) AS job_id, {norm_sql("source || ' LLC'")} AS normalized_company_name,
  TIMESTAMP '{AS_OF}' AS scraped_at, 80000.0::DOUBLE AS salary_min, 120000.0::DOUBLE AS salary_max,
  regexp_matches(lower(text), 'remote|work from home|wfh|distributed|anywhere') AS remote_eligible,
  CASE WHEN length(text) <= 300 THEN text
    ELSE regexp_replace(substring(text, 1, 300), '\.[^.]*$', '') || '.' END AS description_summary
FROM documents""")
def _(spark, sf):
    details = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.concat(F.col("source"), F.lit(" LLC")).alias("company"),
        F.lit("$80k–$120k").alias("salary"), F.lit("2 days ago").alias("posted_date_iso"),
        F.col("text").alias("description_text"))
    return enrich(details, AS_OF).select(
        "job_id", "normalized_company_name", "scraped_at", "salary_min", "salary_max",
        "remote_eligible", "description_summary")
