"""Whole answers: the rows of a page in sections, and its one-row summary."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.times import instant
from vacantia.operators import ordering, sections
from vacantia.plans.search import SearchFilters, envelope, search_page


class Answer(NamedTuple):
    jobs: DataFrame
    summary: DataFrame


def query_jobs(
    jobs: DataFrame,
    applications: DataFrame,
    companies: DataFrame,
    wanted: SearchFilters,
    as_of: Column | datetime | str,
    include: Iterable[str] = ("description_insights",),
    sort_by: str = ordering.SORT_DEFAULT,
    limit: int = 20,
    index: DataFrame | None = None,
) -> Answer:
    """Stored postings: one page in the chosen sections, with returned, total and limit."""
    page = search_page(jobs, applications, companies, wanted, as_of, sort_by, limit, 0, index)
    return Answer(
        sections.with_sections(page, include),
        envelope(jobs, applications, wanted, as_of, limit, 0, index),
    )


def explore(
    cards: DataFrame, details: DataFrame, as_of: Column | datetime | str, limit: int = 10
) -> Answer:
    """Freshly read pages: details of the first cards, in card order, in the fixed live sections.

    ``details`` are enriched detail rows, one per posting. A posting that stands on two of the chosen
    cards is answered twice, a card without details not at all; ``returned`` counts the answers, ``total``
    all cards. The link is the detail's, else the card's. A limit below 1 counts as 1.
    """
    limit = max(1, limit)
    link = F.col("job_url") if "job_url" in cards.columns else F.lit(None).cast("string")
    chosen = cards.orderBy("page_id", "position").limit(limit).select(
        "job_id", "page_id", "position", link.alias("_link"))
    found = chosen.join(details.drop("page_id", "position"), "job_id")
    url = F.coalesce("url", "_link") if "url" in details.columns else F.col("_link")
    rows = found.withColumns({"scraped_at": instant(as_of), "url": url}).orderBy("page_id", "position")
    answered = chosen.join(details.select("job_id"), "job_id").agg(
        F.count(F.lit(1)).alias("returned"), F.lit(0).cast("bigint").alias("total"))
    seen = cards.agg(F.lit(0).cast("bigint").alias("returned"), F.count(F.lit(1)).alias("total"))
    counts = answered.unionByName(seen).agg(
        F.max("returned").alias("returned"), F.max("total").alias("total")
    ).withColumn("limit", F.lit(limit).cast("bigint"))
    return Answer(sections.live_view(rows), counts)
