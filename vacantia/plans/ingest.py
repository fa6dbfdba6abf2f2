"""Raw pages → gated, enriched posting rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.insights import with_insights
from vacantia.functions.salary import with_salary
from vacantia.functions.skills import skills
from vacantia.functions.text import is_remote, normalize_company, offers_visa
from vacantia.functions.times import instant, iso_to_utc
from vacantia.operators.filters import quality_gate
from vacantia.operators.latest import latest_by_key


def cards_with_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Card rows completed by their detail row, so the card-only badge survives.

    The same posting may sit on several result pages. Details are as many as postings and
    wide, so nothing is repeated: a plain join, split adaptively if one posting is on too many.
    """
    badge = cards.select("job_id", "page_id", "position", "benefits_badge", "posted_date_iso")
    wide = details.withColumnRenamed("posted_date_iso", "_detail_iso")
    joined = badge.join(wide, "job_id", "left")
    iso = F.col("_detail_iso")
    card_iso = F.col("posted_date_iso")
    return joined.withColumn(
        "posted_date_iso", F.when(iso_to_utc(iso).isNull(), F.coalesce(card_iso, iso)).otherwise(iso)
    ).drop("_detail_iso")


def first_ids(cards: DataFrame, count: int) -> DataFrame:
    """The first ids in card order."""
    return cards.orderBy("page_id", "position").limit(count).select("job_id")


def enrich(
    details: DataFrame, as_of: Column | datetime | str, text_column: str = "description_text"
) -> DataFrame:
    """Adds every derived column of a posting to detail rows."""
    text = F.col(text_column)
    derived = details.withColumns({
        "normalized_company_name": normalize_company(F.col("company")),
        "posted_at": iso_to_utc(F.col("posted_date_iso")),
        "scraped_at": instant(as_of),
        "last_seen": instant(as_of),
        "skills": skills(text),
        "remote_eligible": is_remote(text),
        "visa_sponsorship": offers_visa(text),
    })
    return with_insights(with_salary(derived), text_column, "skills")


def ingest_pages(
    cards: DataFrame, details: DataFrame, as_of: Column | datetime | str
) -> DataFrame:
    """Gated, enriched rows, one per posting (the last card wins)."""
    completed = cards_with_details(cards, quality_gate(details))
    once = latest_by_key(quality_gate(completed), "job_id", ["page_id", "position"])
    return enrich(once.drop("page_id", "position"), as_of)
