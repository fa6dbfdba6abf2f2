"""J, U: joins and set operations."""

from pyspark.sql import functions as F

from vacantia.operators import keywords, report
from vacantia.operators.changes import change_log, changes_with_jobs, compare_snapshots
from vacantia.operators.latest import latest_by_key
from vacantia.operators.merge import id_changes
from vacantia.plans.ingest import cards_with_details, first_ids
from vacantia.plans.search import list_applications, with_company
from workload.bindings import ctes, table, view, with_tokens
from workload.pages import ANCHOR_SQL, HEAD_SQL, anchors, page_heads
from workload.registry import query


@query("j1_jobs_with_applications", ctes("jobs", "applications") + """
SELECT j.job_id, a.status, a.applied_at FROM jobs j LEFT JOIN applications a ON j.job_id = a.job_id""")
def _(spark, sf):
    tracked = view(spark, sf, "applications").select("job_id", "status", "applied_at")
    return view(spark, sf, "jobs").select("job_id").join(tracked, "job_id", "left")


@query("j2_jobs_with_companies", ctes("jobs", "companies") + """
SELECT j.job_id, c.company_size, c.company_industry, c.company_founded
FROM jobs j LEFT JOIN companies c ON j.normalized_company_name = c.normalized_company_name""")
def _(spark, sf):
    jobs = view(spark, sf, "jobs").select("job_id", "normalized_company_name")
    return with_company(jobs, view(spark, sf, "companies")).select(
        "job_id", "company_size", "company_industry", "company_founded")


@query("j3_applications_with_jobs", ctes("jobs", "applications") + """
SELECT a.job_id, a.status, a.applied_at, a.notes, j.title, j.company, j.location
FROM applications a JOIN jobs j ON a.job_id = j.job_id WHERE a.status = 'applied'""")
def _(spark, sf):
    found = list_applications(view(spark, sf, "applications"), view(spark, sf, "jobs"), "applied")
    return found.select("job_id", "status", "applied_at", "notes", "title", "company", "location")


@query("j4_changes_with_jobs", ctes("jobs", "snapshots") + """,
kept AS (SELECT * FROM jobs WHERE remote_eligible),
steps AS (
  SELECT job_id, scraped_at, value_band, lag(value_band) OVER w AS old_value, row_number() OVER w AS n
  FROM snapshots WINDOW w AS (PARTITION BY job_id ORDER BY scraped_at, event_id)
)
SELECT s.job_id, s.scraped_at AS changed_at, 'value_band' AS field_name, s.old_value,
  s.value_band AS new_value, j.title, j.company
FROM steps s JOIN kept j ON s.job_id = j.job_id
WHERE s.n > 1 AND s.old_value IS DISTINCT FROM s.value_band""")
def _(spark, sf):
    log = change_log(view(spark, sf, "snapshots"), fields=["value_band"], tie_break=["event_id"])
    kept = view(spark, sf, "jobs").filter("remote_eligible")
    return changes_with_jobs(log, kept).select(
        "job_id", "changed_at", "field_name", "old_value", "new_value", "title", "company")


@query("j5_jobs_matching_text", with_tokens() + """
SELECT job_id, company FROM jobs WHERE job_id IN (SELECT job_id FROM tok WHERE token = 'thing')""")
def _(spark, sf):
    jobs = view(spark, sf, "jobs")
    hits = keywords.search_scan(jobs, keywords.word("Thing"))
    return jobs.select("job_id", "company").join(hits, "job_id", "left_semi")


@query("j6_jobs_without_application", """
SELECT d.doc_id AS job_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL""")
def _(spark, sf):
    return report.not_applied(
        table(spark, sf, "documents").select(F.col("doc_id").alias("job_id")),
        table(spark, sf, "labels").select(F.col("doc_id").alias("job_id")))


@query("j7_profiles_with_job_count", ctes("profiles", "jobs") + """
SELECT p.id, p.name, (SELECT count(*) FROM jobs j WHERE j.profile_id = p.id) AS total_jobs_cached
FROM profiles p""")
def _(spark, sf):
    return report.jobs_per_profile(view(spark, sf, "profiles"), view(spark, sf, "jobs")).select(
        "id", "name", "total_jobs_cached")


@query("j8_snapshot_compare", ctes("snapshots") + """,
old AS (SELECT * FROM snapshots WHERE scraped_at < TIMESTAMP '2024-01-20 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, event_id DESC) = 1),
new AS (SELECT * FROM snapshots WHERE scraped_at >= TIMESTAMP '2024-01-20 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC, event_id DESC) = 1)
SELECT n.job_id, n.scraped_at AS changed_at, 'event_type' AS field_name,
  o.event_type AS old_value, n.event_type AS new_value
FROM old o JOIN new n ON o.job_id = n.job_id WHERE o.event_type IS DISTINCT FROM n.event_type
UNION ALL
SELECT n.job_id, n.scraped_at, 'value_band', o.value_band, n.value_band
FROM old o JOIN new n ON o.job_id = n.job_id WHERE o.value_band IS DISTINCT FROM n.value_band""")
def _(spark, sf):
    rows = view(spark, sf, "snapshots").drop("props")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    old = latest_by_key(rows.filter(F.col("scraped_at") < cut), "job_id", ["scraped_at", "event_id"])
    new = latest_by_key(rows.filter(F.col("scraped_at") >= cut), "job_id", ["scraped_at", "event_id"])
    return compare_snapshots(new, old, fields=["event_type", "value_band"])


@query("j9_cards_with_details", f"""
WITH a AS ({ANCHOR_SQL}), d AS ({HEAD_SQL})
SELECT CAST(a.page_id + a.position AS VARCHAR) AS job_id, CAST(a.page_id AS BIGINT) AS page_id,
  a.position, a.text AS benefits_badge, d.title, d.lang
FROM a LEFT JOIN d ON d.page_id = a.page_id + a.position""")
def _(spark, sf):
    cards = anchors(spark, sf).select(
        (F.col("page_id") + F.col("position")).cast("string").alias("job_id"), "page_id", "position",
        F.col("text").alias("benefits_badge"), F.lit(None).cast("string").alias("posted_date_iso"))
    details = page_heads(spark, sf).select(
        F.col("page_id").cast("string").alias("job_id"), "title", "lang",
        F.lit(None).cast("string").alias("posted_date_iso"))
    return cards_with_details(cards, details).select(
        "job_id", "page_id", "position", "benefits_badge", "title", "lang")


@query("j9_first_cards", f"""
WITH a AS ({ANCHOR_SQL})
SELECT CAST(page_id * 100 + position AS VARCHAR) AS job_id FROM a
ORDER BY page_id, position LIMIT 25""")
def _(spark, sf):
    cards = anchors(spark, sf).withColumn(
        "job_id", (F.col("page_id") * 100 + F.col("position")).cast("string"))
    return first_ids(cards, 25)


@query("u1_union_stored_and_incoming", """
SELECT o_orderkey, o_totalprice, NULL AS note FROM orders
UNION ALL SELECT o_orderkey + 10000000, o_totalprice * 2, o_orderstatus FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, sf):
    stored = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    incoming = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") + 10000000).alias("o_orderkey"),
        (F.col("o_totalprice") * 2).alias("o_totalprice"), F.col("o_orderstatus").alias("note"))
    return stored.unionByName(incoming, allowMissingColumns=True)


@query("u2_profile_set_changes", """
WITH o AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
  ELSE 'kept' END AS change_type FROM o FULL JOIN n ON o.id = n.id""")
def _(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return id_changes(ids.filter("id % 3 <> 0"), ids.filter("id % 4 <> 0"), "id")
