"""Composable search over postings, applications and companies."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.operators import filters, keywords, ordering
from vacantia.operators.lookup import lookup
from vacantia.operators.merge import BUCKET
from vacantia.operators.stored_index import StoredIndex

#: Rows of a page up to which its keys go through the driver; a bound on what is collected and broadcast.
PAGE_KEYS = 10_000

COMPANY_COLUMNS = (
    "company_size", "company_industry", "company_description", "company_website",
    "company_headquarters", "company_founded", "company_specialties",
)


@dataclass(frozen=True)
class SearchFilters:
    """Every filter is optional; empty text and 0 mean no filter."""

    company: str | None = None
    location: str | None = None
    keywords: str | keywords.Condition | None = None
    posted_after_hours: int | None = None
    remote_only: bool = False
    visa_sponsorship: bool = False
    application_status: str | None = None


def posting_predicate(wanted: SearchFilters, as_of: Column | datetime | str) -> Column:
    """Conjunction of the filters on the posting's own columns."""
    parts = []
    if wanted.company:
        parts.append(filters.company_is(wanted.company))
    if wanted.location:
        parts.append(filters.located_in(wanted.location))
    if wanted.posted_after_hours:
        parts.append(filters.posted_within(wanted.posted_after_hours, as_of))
    if wanted.remote_only:
        parts.append(filters.flagged("remote_eligible"))
    if wanted.visa_sponsorship:
        parts.append(filters.flagged("visa_sponsorship"))
    result = F.lit(True)
    for part in parts:
        result = result & part
    return result


def matching(
    jobs: DataFrame,
    applications: DataFrame,
    wanted: SearchFilters,
    as_of: Column | datetime | str,
    index: StoredIndex | DataFrame | None = None,
) -> DataFrame:
    """Matching postings with application_status, applied_at and notes.

    Keywords are looked up in the inverted index when one is given, otherwise in the text.
    """
    found = jobs.filter(posting_predicate(wanted, as_of))
    if wanted.keywords:
        condition = (
            keywords.from_text(wanted.keywords, C.INDEXED_FIELDS)
            if isinstance(wanted.keywords, str) else wanted.keywords
        )
        if index is None:
            found = found.filter(condition.scan(keywords.field_texts(found)))
        elif isinstance(index, StoredIndex):
            found = found.join(index.search(condition), "job_id", "left_semi")
        else:
            keys = found.select("job_id") if condition.holds_without_tokens() else None
            hits = keywords.search_index(index, condition, everything=keys)
            found = found.join(hits, "job_id", "left_semi")
    tracked = applications.select(
        "job_id", F.col("status").alias("application_status"), "applied_at", "notes"
    )
    if not wanted.application_status:
        return found.join(tracked, "job_id", "left")
    if wanted.application_status == C.NOT_APPLIED:
        return found.join(tracked, "job_id", "left_anti").withColumns({
            "application_status": F.lit(None).cast("string"),
            "applied_at": F.lit(None).cast("timestamp_ntz"),
            "notes": F.lit(None).cast("string"),
        })
    return found.join(
        tracked.filter(F.col("application_status") == wanted.application_status), "job_id"
    )


def search_page(
    jobs: DataFrame,
    applications: DataFrame,
    companies: DataFrame,
    wanted: SearchFilters,
    as_of: Column | datetime | str,
    sort_by: str = ordering.SORT_DEFAULT,
    limit: int = 20,
    offset: int = 0,
    index: StoredIndex | DataFrame | None = None,
) -> DataFrame:
    """One ordered page of full postings.

    Filtering, joining and ranking run on keys and sort columns only. A page of at most
    ``PAGE_KEYS`` rows is ranked at once: its keys, buckets and application columns come to the driver,
    and the wide columns are read for these keys alone. The keys are pushed to the scan and, on a table
    written by ``write_bucketed``, only their buckets are listed; company facts are read for the
    page's companies. A larger page stays a table and is joined by key.
    """
    order = ordering.order_for(sort_by)
    sort_columns = ["posted_at", "scraped_at", "number_of_applicants"]
    keys = ["job_id"] + [BUCKET] * (BUCKET in jobs.columns)
    tracked = ["application_status", "applied_at", "notes"]
    company = "normalized_company_name"
    ranked = matching(jobs, applications, wanted, as_of, index).select(*keys, company, *sort_columns, *tracked)
    chosen = ordering.page(ranked, order, limit, offset)
    if limit > PAGE_KEYS:
        full = with_company(jobs.join(chosen.drop(company, *sort_columns), keys), companies, spread=False)
        return full.orderBy(*order).limit(limit)
    rows = chosen.collect()
    wide = jobs
    for column in keys:
        wide = wide.filter(F.col(column).isin(sorted({r[column] for r in rows})))
    place = chosen.select("job_id", *tracked).schema
    page = jobs.sparkSession.createDataFrame([(r["job_id"], *[r[c] for c in tracked]) for r in rows], place)
    names = sorted({r[company] for r in rows if r[company] is not None})
    facts = companies.filter(F.col(company).isin(names))
    full = with_company(wide.join(F.broadcast(page), "job_id"), facts, spread=False)
    return full.orderBy(*order).limit(limit)


def with_company(jobs: DataFrame, companies: DataFrame, spread: bool = True) -> DataFrame:
    """Company facts by normalised name.

    One company may own a third of all postings, so these are spread unless they are a page.
    """
    present = [c for c in COMPANY_COLUMNS if c in companies.columns]
    facts = companies.select("normalized_company_name", *present)
    joined = lookup(jobs, facts, "normalized_company_name", "left", "job_id" if spread else None)
    missing = {c: F.lit(None) for c in COMPANY_COLUMNS if c not in present}
    kinds = {"company_founded": "int", "company_specialties": "array<string>"}
    return joined.withColumns(
        {c: value.cast(kinds.get(c, "string")) for c, value in missing.items()}
    ) if missing else joined


def count_matches(
    jobs: DataFrame,
    applications: DataFrame,
    wanted: SearchFilters,
    as_of: Column | datetime | str,
    index: StoredIndex | DataFrame | None = None,
) -> DataFrame:
    rows = matching(jobs, applications, wanted, as_of, index).select("job_id")
    return rows.agg(F.count(F.lit(1)).alias("total"))


def envelope(
    jobs: DataFrame,
    applications: DataFrame,
    wanted: SearchFilters,
    as_of: Column | datetime | str,
    limit: int = 20,
    offset: int = 0,
    index: StoredIndex | DataFrame | None = None,
) -> DataFrame:
    """returned, total and limit of a page, from the match count alone."""
    total = F.col("total")
    left = F.greatest(total - offset, F.lit(0).cast("bigint"))
    return count_matches(jobs, applications, wanted, as_of, index).select(
        F.least(left, F.lit(limit).cast("bigint")).alias("returned"),
        total,
        F.lit(limit).cast("bigint").alias("limit"),
    )


def list_applications(
    applications: DataFrame, jobs: DataFrame, status: str | None = None
) -> DataFrame:
    """Applications with the posting's names, newest first."""
    chosen = applications.filter(F.col("status") == status) if status else applications
    names = jobs.select("job_id", "title", "company", "location")
    return chosen.join(names, "job_id").orderBy(*ordering.newest_first("applied_at", "job_id"))
