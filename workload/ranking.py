"""O, W: sorts, pages, last rows, change log."""

from pyspark.sql import functions as F

from vacantia.functions.text import leading_integer
from vacantia.operators import ordering, report
from vacantia.operators.changes import change_log
from vacantia.operators.latest import latest_by_key
from workload.bindings import ctes, table, view
from workload.registry import query


@query("o1_newest_posted", """
SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordering.page(rows, ordering.newest_first("o_orderdate", "o_orderkey"), 50)


@query("o2_newest_scraped", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 50""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ordering.page(rows, ordering.newest_first("l_shipdate", "l_orderkey", "l_linenumber"), 50)


@query("o3_most_applicants", ctes("jobs") + r"""
SELECT job_id, number_of_applicants FROM jobs
ORDER BY CASE WHEN number_of_applicants IS NOT NULL THEN
  coalesce(try_cast(regexp_extract(number_of_applicants, '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) END
  DESC NULLS LAST, job_id LIMIT 300""")
def _(spark, sf):
    rows = view(spark, sf, "jobs").select("job_id", "number_of_applicants")
    return ordering.page(rows, ordering.order_for("applicants"), 300)


@query("o4_unknown_sort_key", ctes("jobs") + """
SELECT job_id, posted_at FROM jobs ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 40""")
def _(spark, sf):
    rows = view(spark, sf, "jobs").select("job_id", "posted_at")
    return ordering.page(rows, ordering.order_for("posted_date_iso"), 40)


@query("o5_offset_page", ctes("jobs") + """
SELECT job_id, scraped_at FROM jobs ORDER BY scraped_at DESC NULLS LAST, job_id LIMIT 20 OFFSET 60""")
def _(spark, sf):
    rows = view(spark, sf, "jobs").select("job_id", "scraped_at")
    return ordering.page(rows, ordering.order_for("scraped_at"), 20, offset=60)


@query("o6_profile_listing", ctes("profiles") + """
SELECT id, created_at FROM profiles ORDER BY created_at, id LIMIT 100""")
def _(spark, sf):
    rows = view(spark, sf, "profiles").select("id", "created_at")
    return ordering.page(rows, ordering.profile_listing(rows), 100)


@query("o6_newest_events", """
SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return ordering.page(rows, ordering.newest_first("ts", "event_id"), 100)


@query("o7_top_groups", """
SELECT o_custkey, count(*) AS jobs FROM orders GROUP BY o_custkey ORDER BY jobs DESC, o_custkey LIMIT 10""")
def _(spark, sf):
    return report.top_locations(table(spark, sf, "orders"), column="o_custkey")


@query("w1_last_write_per_key", """
SELECT user_id, event_id, ts, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, sf):
    return latest_by_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


_CHANGE_LOG = ctes("snapshots") + """,
steps AS (
  SELECT job_id, scraped_at, event_type, value_band, props,
    lag(event_type) OVER w AS e, lag(value_band) OVER w AS v, lag(props) OVER w AS p,
    row_number() OVER w AS n
  FROM snapshots WINDOW w AS (PARTITION BY job_id ORDER BY scraped_at, event_id)
)
SELECT job_id, scraped_at AS changed_at, 'event_type' AS field_name, e AS old_value, event_type AS new_value
FROM steps WHERE n > 1 AND e IS DISTINCT FROM event_type
UNION ALL SELECT job_id, scraped_at, 'value_band', v, value_band FROM steps
WHERE n > 1 AND v IS DISTINCT FROM value_band
UNION ALL SELECT job_id, scraped_at, 'props', p, props FROM steps
WHERE n > 1 AND p IS DISTINCT FROM props"""


@query("w2_field_change_log", _CHANGE_LOG)
def _(spark, sf):
    return change_log(view(spark, sf, "snapshots"), fields=["event_type", "value_band", "props"],
                      tie_break=["event_id"])


@query("w2_change_log_by_rows", _CHANGE_LOG)
def _(spark, sf):
    """The same log with slices by number of rows, which no burst of one key can fill."""
    return change_log(view(spark, sf, "snapshots"), fields=["event_type", "value_band", "props"],
                      tie_break=["event_id"], slice_width=None)
