"""Column layouts of the stored tables and of legacy input."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS, _LIST = T.TimestampNTZType(), T.ArrayType(T.StringType())


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


POSTINGS = _struct(
    ("job_id", _S), ("title", _S), ("company", _S), ("normalized_company_name", _S),
    ("location", _S), ("posted_date", _S), ("posted_date_iso", _S), ("posted_at", _TS),
    ("scraped_at", _TS), ("last_seen", _TS), ("salary", _S), ("salary_min", _D),
    ("salary_max", _D), ("salary_currency", _S), ("equity_offered", _B),
    ("remote_eligible", _B), ("visa_sponsorship", _B), ("easy_apply", _B), ("skills", _LIST),
    ("number_of_applicants", _S), ("description_summary", _S), ("key_requirements", _LIST),
    ("key_responsibilities_preview", _S), ("raw_description", _S), ("employment_type", _S),
    ("seniority_level", _S), ("job_function", _S), ("industries", _S), ("benefits_badge", _S),
    ("company_url", _S), ("url", _S), ("source", _S), ("profile_id", _L),
)

PROFILES = _struct(
    ("id", _L), ("name", _S), ("location", _S), ("keywords", _S), ("distance", _I),
    ("time_filter", _S), ("refresh_interval", _I), ("enabled", _B), ("last_scraped_at", _TS),
    ("created_at", _TS), ("updated_at", _TS),
)

APPLICATIONS = _struct(
    ("job_id", _S), ("applied_at", _TS), ("status", _S), ("notes", _S),
    ("created_at", _TS), ("updated_at", _TS),
)

COMPANIES = _struct(
    ("company_name", _S), ("normalized_company_name", _S), ("company_size", _S),
    ("company_industry", _S), ("company_description", _S), ("company_website", _S),
    ("company_headquarters", _S), ("company_founded", _I), ("company_specialties", _LIST),
    ("company_page_url", _S), ("scraped_at", _TS), ("next_refresh_at", _TS),
)

CHANGES = _struct(
    ("job_id", _S), ("changed_at", _TS), ("field_name", _S), ("old_value", _S), ("new_value", _S),
)

TABLES = {
    "jobs": POSTINGS,
    "profiles": PROFILES,
    "applications": APPLICATIONS,
    "companies": COMPANIES,
    "job_changes": CHANGES,
}

LEGACY = _struct(
    ("job_id", _S), ("title", _S), ("company", _S), ("company_url", _S), ("location", _S),
    ("posted_date", _S), ("scraped_at", _S), ("salary", _S), ("raw_description", _S),
    ("employment_type", _S), ("seniority_level", _S), ("job_function", _S), ("industries", _S),
    ("number_of_applicants", _S), ("url", _S), ("source", _S),
)
