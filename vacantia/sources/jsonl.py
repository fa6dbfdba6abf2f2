"""JSON lines and the legacy posting layout."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import constants as C
from vacantia.functions.salary import with_salary
from vacantia.functions.skills import skills
from vacantia.functions.text import is_remote, normalize_company, offers_visa
from vacantia.functions.times import instant, iso_to_utc
from vacantia.schema import LEGACY

CORRUPT = "_corrupt_record"


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = LEGACY) -> DataFrame:
    """One object per line. Unreadable lines keep their text in ``_corrupt_record``.

    Read as text lines and then parsed whole: the JSON file reader would skip the columns a
    query does not use, and so call a line good or bad depending on the query.
    """
    return parse_jsonl(spark.read.text(path), "value", schema)


def parse_jsonl(lines: DataFrame, column: str, schema: T.StructType = LEGACY) -> DataFrame:
    """JSON lines held in a column. Blank lines are dropped.

    A line that is not a JSON object (text, list, number) counts as unreadable.
    """
    line = F.col(column)
    layout = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json(line, layout, {"columnNameOfCorruptRecord": CORRUPT})
    return (
        lines.filter(F.trim(line) != "")
        .select(*[c for c in lines.columns if c != column], line.alias("_text"),
                record.alias("_record"))
        .select(
            *[c for c in lines.columns if c != column],
            *[F.col(f"_record.{f.name}").alias(f.name) for f in schema.fields],
            F.when(~F.ltrim(F.col("_text")).startswith("{"), F.col("_text"))
            .otherwise(F.col(f"_record.{CORRUPT}")).alias(CORRUPT),
        )
    )


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(records: DataFrame) -> DataFrame:
    return records.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def legacy_to_jobs(
    records: DataFrame, as_of: Column | datetime | str, default_source: str | None = None
) -> DataFrame:
    """Old posting records in the current layout.

    Missing text becomes NULL, the scrape time doubles as posting time, and salary range,
    flags and skills are derived from the raw text.
    """
    now = instant(as_of)
    description = F.coalesce(F.col("raw_description"), F.lit(""))
    scraped_text = F.nullif(F.col("scraped_at"), F.lit(""))
    scraped = F.when(scraped_text.isNull(), now).otherwise(iso_to_utc(scraped_text))
    optional = [
        "title", "company", "company_url", "location", "posted_date", "employment_type",
        "seniority_level", "job_function", "industries", "number_of_applicants", "url", "salary",
    ]
    shaped = records.select(
        "job_id",
        *[F.nullif(F.col(name), F.lit(C.MISSING)).alias(name) for name in optional],
        normalize_company(F.coalesce(F.col("company"), F.lit(C.MISSING)))
        .alias("normalized_company_name"),
        F.coalesce(scraped_text, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("posted_date_iso"),
        scraped.alias("posted_at"),
        scraped.alias("scraped_at"),
        now.alias("last_seen"),
        description.alias("raw_description"),
        is_remote(description).alias("remote_eligible"),
        offers_visa(description).alias("visa_sponsorship"),
        skills(description).alias("skills"),
        F.lit(False).alias("easy_apply"),
        F.lit(None).cast("string").alias("benefits_badge"),
        F.coalesce(F.col("source"), F.lit(default_source)).alias("source"),
        F.lit(None).cast("bigint").alias("profile_id"),
    )
    return with_salary(shaped)
