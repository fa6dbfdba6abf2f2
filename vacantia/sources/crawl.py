"""The list of pages a crawler should fetch. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C

PAGE_SIZE = 10


def pages_for(limit: int) -> int:
    """Result pages needed for so many postings, at least one."""
    return max(1, -(-limit // PAGE_SIZE))


def valid_distance(distance: Column) -> Column:
    """A distance outside the domain falls back to the default."""
    allowed = F.coalesce(distance.isin(list(C.PROFILE_DISTANCES)), F.lit(False))
    return F.when(allowed, distance).otherwise(F.lit(C.PROFILE_DEFAULTS["distance"]))


def crawl_plan(
    profiles: DataFrame,
    base_url: str,
    pages: int = 5,
    time_filter_key: str = "f_TPR",
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Profiles × result pages → request rows with their query string.

    An extra filter with the name of a standard one replaces its value in place.
    """
    requests = profiles.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    start = F.col("page") * PAGE_SIZE
    values: dict[str, Column] = {
        "keywords": F.col("keywords"),
        "location": F.col("location"),
        "distance": F.col("distance").cast("string"),
        "start": start.cast("string"),
        time_filter_key: F.col("time_filter"),
    }
    values.update({key: F.lit(value) for key, value in (extra or {}).items()})
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in values.items()])
    return requests.select(
        F.col("id").alias("profile_id"),
        "page",
        start.alias("start"),
        F.concat(F.lit(f"{base_url}?"), query).alias("url"),
    )


def detail_requests(job_ids: DataFrame, base_url: str, key: str = "job_id") -> DataFrame:
    return job_ids.select(key, F.concat(F.lit(f"{base_url}/"), F.col(key)).alias("url"))
