"""K: merges, folds, retention, audit rows."""

from pyspark.sql import functions as F

from vacantia import work_dir
from vacantia.operators import folds, merge, upkeep
from vacantia.operators.changes import change_log
from vacantia.operators.day_table import DayTable, retain
from vacantia.operators.stored_table import StoredTable
from workload.bindings import AS_OF, ctes, norm_sql, table, view
from workload.registry import query

NOW = f"TIMESTAMP '{AS_OF}'"


def _order_batch(spark, sf):
    """Two versions of every tenth order, one of every fiftieth as a new key."""
    orders = table(spark, sf, "orders")
    tenth = orders.filter("o_orderkey % 10 = 3")
    parts = [
        tenth.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("seq", F.lit(1)),
        tenth.withColumn("o_totalprice", F.col("o_totalprice") + 2).withColumn("seq", F.lit(2)),
        orders.filter("o_orderkey % 50 = 7").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
        .withColumn("seq", F.lit(3)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_UPSERTED = """
SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders
UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 50 = 7"""


@query("k1_upsert_replace", _UPSERTED)
def _(spark, sf):
    return merge.upsert_replace(
        table(spark, sf, "orders"), _order_batch(spark, sf), "o_orderkey", "seq")


@query("k1_upsert_stored_table", _UPSERTED)
def _(spark, sf):
    """The same against a stored, bucketed table that is rewritten in place."""
    path = work_dir(spark, "orders")
    merge.write_bucketed(table(spark, sf, "orders"), path, "o_orderkey", 8)
    merge.upsert_into(spark, path, _order_batch(spark, sf), "o_orderkey", "seq", 8)
    return spark.read.parquet(path).drop(merge.BUCKET)


@query("k1_upsert_counts", """
SELECT 2 * count(*) FILTER (o_orderkey % 10 = 3) + count(*) FILTER (o_orderkey % 50 = 7) AS input_rows,
  count(*) FILTER (o_orderkey % 10 = 3) + count(*) FILTER (o_orderkey % 50 = 7) AS distinct_keys,
  count(*) FILTER (o_orderkey % 10 = 3) AS replaced FROM orders""")
def _(spark, sf):
    return merge.upsert_counts(table(spark, sf, "orders"), _order_batch(spark, sf), "o_orderkey")


@query("k2_merge_keep", """
SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, 'added', NULL, NULL, 'NEW' FROM customer WHERE c_custkey % 4 = 0""")
def _(spark, sf):
    customers = table(spark, sf, "customer")
    changed = customers.filter("c_custkey % 4 = 0")
    facts = [F.lit("added").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"),
             F.lit("NEW").alias("c_mktsegment")]
    batch = changed.select("c_custkey", *facts).unionByName(
        changed.select((F.col("c_custkey") + 1000000).alias("c_custkey"), *facts))
    return merge.merge_keep(customers, batch, "c_custkey", keep=["c_name"])


@query("k3_enrichment_merge", ctes("companies") + f""",
batch AS (SELECT 'Src' || s_suppkey || ', Inc.' AS company_name, s_suppkey, s_name FROM supplier),
fresh AS (SELECT *, {norm_sql('company_name')} AS n FROM batch)
SELECT coalesce(f.n, c.normalized_company_name) AS normalized_company_name,
  coalesce(f.company_name, c.company_name) AS company_name,
  CASE WHEN f.n IS NOT NULL THEN f.s_name ELSE c.company_industry END AS company_industry,
  c.company_headquarters,
  CASE WHEN f.n IS NOT NULL THEN 'x|' || f.s_name ELSE array_to_string(c.company_specialties, '|') END AS specialties,
  CASE WHEN f.n IS NOT NULL THEN {NOW} ELSE c.scraped_at END AS scraped_at,
  CASE WHEN f.n IS NOT NULL THEN {NOW} + to_days(30) ELSE c.next_refresh_at END AS next_refresh_at
FROM companies c FULL JOIN fresh f ON c.normalized_company_name = f.n""")
def _(spark, sf):
    suppliers = table(spark, sf, "supplier")
    batch = suppliers.select(
        F.concat(F.lit("Src"), F.col("s_suppkey").cast("string"), F.lit(", Inc.")).alias("company_name"),
        F.col("s_name").alias("company_industry"),
        F.array(F.lit("x"), F.col("s_name")).alias("company_specialties"),
        F.col("s_suppkey").alias("seq"))
    merged = merge.enrichment_merge(view(spark, sf, "companies"), batch, AS_OF, "seq")
    return merged.select(
        "normalized_company_name", "company_name", "company_industry", "company_headquarters",
        F.array_join("company_specialties", "|").alias("specialties"), "scraped_at", "next_refresh_at")


_STEPS = """
steps AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id,
  CASE WHEN event_type = 'purchase' THEN 'apply' ELSE 'status' END AS action,
  CASE event_type WHEN 'click' THEN 'interviewing' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'offered' END AS status,
  CASE WHEN event_id % 3 <> 0 THEN props END AS notes
  FROM events WHERE event_type <> 'view'),
known AS (SELECT CAST(doc_id AS VARCHAR) AS job_id FROM documents WHERE doc_id % 4 <> 0)"""


def _application_events(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").filter("event_type <> 'view'").select(
        F.col("user_id").cast("string").alias("job_id"), "ts", "event_id",
        F.when(kind == "purchase", "apply").otherwise("status").alias("action"),
        F.when(kind == "click", "interviewing").when(kind == "error", "rejected")
        .when(kind == "signup", "offered").alias("status"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("notes"))


def _known_jobs(spark, sf):
    return table(spark, sf, "documents").filter("doc_id % 4 <> 0").select(
        F.col("doc_id").cast("string").alias("job_id"))


@query("k4_fold_applications", f"""
WITH {_STEPS},
ranked AS (SELECT s.*, count(*) FILTER (action = 'apply') OVER w AS applies,
    row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS back
  FROM steps s WHERE job_id IN (SELECT job_id FROM known)
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
valid AS (SELECT * FROM ranked WHERE applies > 0)
SELECT job_id, max(ts) FILTER (action = 'apply') AS applied_at,
  max(CASE WHEN action = 'apply' THEN 'applied' ELSE status END) FILTER (back = 1) AS status,
  coalesce(max(notes) FILTER (back = 1), '') AS notes,
  min(ts) FILTER (action = 'apply') AS created_at, max(ts) AS updated_at
FROM valid GROUP BY job_id""")
def _(spark, sf):
    return folds.fold_applications(
        _application_events(spark, sf), _known_jobs(spark, sf), tie_break=["event_id"])


@query("k4_rejected_events", f"""
WITH {_STEPS},
seen AS (SELECT s.*, count(*) FILTER (action = 'apply') OVER (PARTITION BY job_id ORDER BY ts, event_id) AS applies FROM steps s)
SELECT job_id, event_id, CASE WHEN job_id NOT IN (SELECT job_id FROM known) THEN 'unknown job'
  ELSE 'no application' END AS reason
FROM seen WHERE job_id NOT IN (SELECT job_id FROM known) OR applies = 0""")
def _(spark, sf):
    return folds.rejected_application_events(
        _application_events(spark, sf), _known_jobs(spark, sf), tie_break=["event_id"],
    ).select("job_id", "event_id", "reason")


@query("k5_fold_profiles", """
WITH e AS (SELECT 'p' || user_id AS name, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'disable' WHEN 'purchase' THEN 'delete' ELSE 'update' END AS action,
    CASE WHEN event_type = 'signup' OR event_id % 3 = 0 THEN 'L' || (event_id % 7) END AS location,
    CASE WHEN event_type = 'signup' OR event_id % 4 = 0 THEN 'K' || (event_id % 5) END AS keywords,
    CASE WHEN event_id % 5 = 0 THEN 50 END AS distance,
    CASE WHEN event_id % 6 = 0 THEN 7200 END AS refresh_interval,
    CASE WHEN event_type <> 'error' AND event_id % 8 = 0 THEN true END AS enabled FROM events),
d AS (SELECT name, max(event_id) FILTER (action = 'delete') AS gone FROM e GROUP BY name),
live AS (SELECT e.* FROM e JOIN d USING (name) WHERE d.gone IS NULL OR e.event_id > d.gone),
a AS (SELECT name, min(event_id) FILTER (action = 'add') AS born, max(event_id) FILTER (action = 'add') AS reset FROM live GROUP BY name),
ok AS (SELECT live.*, a.born, a.reset FROM live JOIN a USING (name) WHERE live.event_id >= a.born),
cur AS (SELECT name, event_id,
  location, keywords,
  CASE WHEN action = 'add' THEN coalesce(distance, 25) ELSE distance END AS distance,
  CASE WHEN action = 'add' THEN coalesce(refresh_interval, 3600) ELSE refresh_interval END AS refresh_interval,
  CASE WHEN action = 'disable' THEN false WHEN action = 'add' THEN coalesce(enabled, true) ELSE enabled END AS enabled
  FROM ok WHERE event_id >= reset)
SELECT c.name,
  max_by(location, event_id) FILTER (location IS NOT NULL) AS location,
  max_by(keywords, event_id) FILTER (keywords IS NOT NULL) AS keywords,
  max_by(distance, event_id) FILTER (distance IS NOT NULL) AS distance,
  'r86400' AS time_filter,
  max_by(refresh_interval, event_id) FILTER (refresh_interval IS NOT NULL) AS refresh_interval,
  max_by(enabled, event_id) FILTER (enabled IS NOT NULL) AS enabled,
  (SELECT min(ts) FROM ok WHERE ok.name = c.name AND action = 'add') AS created_at,
  (SELECT max(ts) FROM ok WHERE ok.name = c.name) AS updated_at
FROM cur c GROUP BY c.name""")
def _(spark, sf):
    kind, eid = F.col("event_type"), F.col("event_id")
    events = table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"), "ts", "event_id",
        F.when(kind == "signup", "add").when(kind == "error", "disable")
        .when(kind == "purchase", "delete").otherwise("update").alias("action"),
        F.when((kind == "signup") | (eid % 3 == 0), F.concat(F.lit("L"), (eid % 7).cast("string")))
        .alias("location"),
        F.when((kind == "signup") | (eid % 4 == 0), F.concat(F.lit("K"), (eid % 5).cast("string")))
        .alias("keywords"),
        F.when(eid % 5 == 0, 50).alias("distance"),
        F.lit(None).cast("string").alias("time_filter"),
        F.when(eid % 6 == 0, 7200).alias("refresh_interval"),
        F.when((kind != "error") & (eid % 8 == 0), True).alias("enabled"))
    return folds.fold_profiles(events, tie_break=["event_id"])


@query("k6_set_null_on_delete", ctes("jobs", "profiles") + """
SELECT job_id, CASE WHEN profile_id IN (SELECT id FROM profiles WHERE id % 7 <> 0) THEN profile_id END AS profile_id
FROM jobs""")
def _(spark, sf):
    jobs = view(spark, sf, "jobs").select("job_id", "profile_id")
    kept = view(spark, sf, "profiles").filter("id % 7 <> 0")
    return upkeep.set_null_on_parent_delete(jobs, kept)


@query("k7_retention", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - to_days(1000)""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return upkeep.retention(rows, "2001-08-01 00:00:00", 1000 * 86400, "o_orderdate")


@query("k8_cascade", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - to_days(1000))""")
def _(spark, sf):
    kept = upkeep.retention(table(spark, sf, "orders"), "2001-08-01 00:00:00", 1000 * 86400, "o_orderdate")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return upkeep.cascade(lines, kept, "o_orderkey").withColumnRenamed(
        "o_orderkey", "l_orderkey")


def _retained(spark, sf):
    """Postings by day and applications by bucket, stored; then postings older than 20 days go."""
    base = work_dir(spark, "retention")
    jobs = view(spark, sf, "jobs").select("job_id", "company", "scraped_at", "raw_description")
    applications = view(spark, sf, "applications").select("job_id", "status", "updated_at")
    days = DayTable.open(spark, f"{base}/jobs", jobs.schema).add(jobs, 2)
    child = StoredTable.open(spark, f"{base}/applications", applications.schema, "job_id", 8).upsert(
        applications, 0, "updated_at")
    return retain(days, [child], AS_OF, 20 * 86400)


@query("k7_stored_retention", ctes("jobs") + f"""
SELECT job_id, company, scraped_at, raw_description FROM jobs WHERE scraped_at >= {NOW} - to_days(20)""")
def _(spark, sf):
    return _retained(spark, sf).jobs.read()


@query("k7_deleted_count", ctes("jobs") + f"""
SELECT count(*) AS deleted FROM jobs WHERE scraped_at < {NOW} - to_days(20)""")
def _(spark, sf):
    return spark.range(1).select(F.lit(_retained(spark, sf).deleted).cast("long").alias("deleted"))


@query("k8_stored_cascade", ctes("jobs", "applications") + f"""
SELECT job_id, status, updated_at FROM applications
WHERE job_id IN (SELECT job_id FROM jobs WHERE scraped_at >= {NOW} - to_days(20))""")
def _(spark, sf):
    return _retained(spark, sf).children[0].read()


@query("k9_touch_last_run", ctes("profiles") + """
SELECT p.id, coalesce((SELECT max(ts) FROM events e WHERE e.user_id * 3 = p.id), p.last_scraped_at) AS last_scraped_at
FROM profiles p""")
def _(spark, sf):
    runs = table(spark, sf, "events").select(
        (F.col("user_id") * 3).alias("profile_id"), F.col("ts").alias("run_at"))
    return upkeep.touch_last_run(view(spark, sf, "profiles"), runs).select("id", "last_scraped_at")


@query("k10_append_changes", ctes("snapshots") + """,
steps AS (SELECT job_id, scraped_at, event_type, lag(event_type) OVER w AS o, row_number() OVER w AS n
  FROM snapshots WINDOW w AS (PARTITION BY job_id ORDER BY scraped_at, event_id))
SELECT CAST(scraped_at AS DATE) AS day, job_id, scraped_at AS changed_at, o AS old_value, event_type AS new_value
FROM steps WHERE n > 1 AND o IS DISTINCT FROM event_type""")
def _(spark, sf):
    path = work_dir(spark, "changes")
    log = change_log(view(spark, sf, "snapshots"), fields=["event_type"], tie_break=["event_id"])
    upkeep.append_changes(log, path)
    return spark.read.parquet(path).select("day", "job_id", "changed_at", "old_value", "new_value")
