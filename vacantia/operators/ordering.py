"""Sort orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import leading_integer

SORT_DEFAULT = "posted_date"


def sort_orders(key: str = "job_id") -> dict[str, list[Column]]:
    """Sort name → order; the key breaks ties."""
    tie = F.asc(key)
    return {
        "posted_date": [F.desc_nulls_last("posted_at"), tie],
        "scraped_at": [F.desc_nulls_last("scraped_at"), tie],
        "applicants": [leading_integer(F.col("number_of_applicants")).desc_nulls_last(), tie],
    }


def order_for(sort_by: str, key: str = "job_id") -> list[Column]:
    """An unknown name means newest posting first."""
    orders = sort_orders(key)
    return orders.get(sort_by, orders[SORT_DEFAULT])


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order: a bounded top-k per task, then a merge of those."""
    ordered = rows.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def profile_listing(profiles: DataFrame) -> list[Column]:
    return [F.asc("created_at"), F.asc("id")]


def newest_first(time: str, *tie_break: str) -> list[Column]:
    return [F.desc_nulls_last(time), *[F.asc(c) for c in tie_break]]
