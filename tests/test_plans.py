"""The plans are the ones wanted: pruned scans, pushed filters, no pair-wise joins."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vacantia.operators import filters, text_index, upkeep
from vacantia.operators.merge import upsert_replace
from workload.bindings import table, view

SF = "/root/testdata/sf0.001"
STREAMED = ("r1_", "r2_", "r3_", "r4_", "r5_", "k1_upsert_stored", "k10_", "k11_")


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(STREAMED)])
def test_no_pairwise_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_retention_filter_reaches_the_scan(spark):
    kept = upkeep.retention(table(spark, SF, "orders"), "2001-08-01 00:00:00", 86400, "o_orderdate")
    assert "PushedFilters: [Or(GreaterThanOrEqual(o_orderdate," in plan(kept)


def test_posted_within_reaches_the_scan(spark):
    recent = table(spark, SF, "orders").filter(
        filters.posted_within(24, "2001-08-01 00:00:00", "o_orderdate")).select("o_orderkey")
    text = plan(recent)
    assert "GreaterThanOrEqual(o_orderdate," in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_report_reads_no_text(spark):
    """The report's scans of the postings leave the description out."""
    text = plan(entry.queries()["a6_top_companies"](spark, SF))
    assert "text:string" not in text
    assert "TakeOrderedAndProject" in text


def test_index_is_built_without_a_shuffle(spark):
    assert "Exchange" not in plan(text_index.build_index(view(spark, SF, "jobs")))


def test_page_uses_top_k(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["p1_wide_search_page"](spark, SF))


def test_upsert_does_not_shuffle_the_stored_table(spark):
    orders = table(spark, SF, "orders")
    batch = orders.limit(5).withColumn("seq", orders["o_orderkey"])
    text = plan(upsert_replace(orders, batch, "o_orderkey", "seq"))
    assert "BroadcastHashJoin LeftAnti" in text


def test_page_keys_reach_the_wide_scan(spark, tmp_path):
    from vacantia.plans.search import SearchFilters, search_page

    view(spark, SF, "jobs").write.parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    page = search_page(jobs, view(spark, SF, "applications"), view(spark, SF, "companies"),
                       SearchFilters(), "2024-01-31 00:00:00", limit=3)
    assert "In(job_id, [" in plan(page)


@pytest.mark.parametrize("limit", [20, 1000])
def test_a_page_reads_the_wide_columns_of_its_keys_only(spark, tmp_path, limit):
    from vacantia.operators.merge import write_bucketed
    from vacantia.plans.search import SearchFilters, search_page

    wide = view(spark, SF, "jobs")
    write_bucketed(wide.unionByName(wide.withColumn("job_id", F.concat("job_id", F.lit("x")))), str(tmp_path / "jobs"), "job_id", 64, 1)
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    rest = (view(spark, SF, "applications"), view(spark, SF, "companies"), SearchFilters(location="e"), "2024-01-31 00:00:00")
    page = search_page(jobs, *rest, limit=limit)
    text = plan(page)
    assert "PartitionFilters: [bucket" in text and "In(job_id, [" in text
    # The same page from a table that knows no buckets.
    plain = search_page(jobs.drop("bucket"), *rest, limit=limit)
    assert [r.job_id for r in page.collect()] == [r.job_id for r in plain.collect()]
    if limit == 20:
        listed = re.search(r"bucket#\d+ IN(?:SET)? \(?([0-9, ]+)", page._jdf.queryExecution().optimizedPlan().toString())
        assert listed and 0 < len(listed[1].split(",")) <= 20


def test_change_log_shuffles_the_snapshots_once(spark):
    log = entry.queries()["w2_field_change_log"](spark, SF)
    log.collect()
    executed = log._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in executed
