"""Result sections: nested views of a found posting.

Each section is a struct, NULL when it does not apply. Input columns are those of
:func:`vacantia.plans.search.search_page`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import na_to_null

_TIME = "yyyy-MM-dd'T'HH:mm:ss"


def _time(name: str) -> Column:
    return F.date_format(name, _TIME)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def core() -> Column:
    return F.struct(
        "job_id", "title", "company", "location", "posted_date", "posted_date_iso"
    )


def decision_making() -> Column:
    return F.struct(
        F.col("salary").alias("salary_range"),
        _flag("remote_eligible").alias("remote_eligible"),
        _flag("visa_sponsorship").alias("visa_sponsorship"),
        F.col("number_of_applicants").alias("applicants"),
        _flag("easy_apply").alias("easy_apply"),
    )


def description_insights() -> Column:
    return F.struct(
        F.col("description_summary"),
        _list("key_requirements").alias("key_requirements"),
        F.col("key_responsibilities_preview"),
    )


def application_tracking() -> Column:
    status = F.nullif(F.col("application_status"), F.lit(""))
    return F.when(status.isNotNull(), F.struct(
        F.col("application_status"),
        _time("applied_at").alias("applied_at"),
        F.col("notes").alias("application_notes"),
    ))


def company_enrichment() -> Column:
    return F.struct(
        "company_size", "company_industry", "company_description", "company_website",
        "company_headquarters", "company_founded",
        _list("company_specialties").alias("company_specialties"),
    )


def metadata() -> Column:
    return F.struct(
        F.col("url").alias("job_url"),
        _time("scraped_at").alias("scraped_at"),
        _time("scraped_at").alias("last_seen"),
        F.col("seniority_level"),
        F.col("employment_type"),
    )


def full_description() -> Column:
    return F.struct(F.col("raw_description").alias("description"))


def complete_skills() -> Column:
    return F.struct(
        _list("skills").alias("skills_required"),
        F.array().cast("array<string>").alias("skills_preferred"),
    )


def benefits() -> Column:
    badge = F.nullif(F.col("benefits_badge"), F.lit(""))
    return F.struct(
        F.when(badge.isNotNull(), F.array(badge)).otherwise(F.array().cast("array<string>"))
        .alias("benefits")
    )


def employment_details(onsite_label: str | None = "On-site") -> Column:
    return F.struct(
        F.when(_flag("remote_eligible"), "Remote").otherwise(F.lit(onsite_label))
        .alias("workplace_type"),
        F.col("seniority_level").alias("experience_level"),
        F.col("industries").alias("industry"),
    )


SECTIONS = {
    "core": core,
    "decision_making": decision_making,
    "description_insights": description_insights,
    "application_tracking": application_tracking,
    "company_enrichment": company_enrichment,
    "metadata": metadata,
    "full_description": full_description,
    "complete_skills": complete_skills,
    "benefits": benefits,
    "employment_details": employment_details,
}
ALWAYS = ("core", "decision_making")


def with_sections(found: DataFrame, include: Iterable[str] = ("description_insights",)) -> DataFrame:
    """job_id plus one struct column per section, in fixed order."""
    wanted = {*ALWAYS, *include}
    unknown = wanted - SECTIONS.keys()
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return found.select(
        "job_id", *[make().alias(name) for name, make in SECTIONS.items() if name in wanted]
    )


def as_json(sections: DataFrame) -> DataFrame:
    """One JSON text per posting; NULL fields are left out, empty lists are kept."""
    names = [c for c in sections.columns if c != "job_id"]
    return sections.select("job_id", F.to_json(F.struct(*names)).alias("response"))


def live_view(details: DataFrame, limit: int = 500) -> DataFrame:
    """Fixed sections for freshly read detail pages; the summary is the plain head."""
    text = na_to_null(F.col("raw_description"))
    shaped = details.withColumns({
        "description_summary": F.substring(text, 1, limit),
        "key_requirements": F.array().cast("array<string>"),
        "key_responsibilities_preview": F.lit(None).cast("string"),
        "raw_description": text,
        **{
            name: na_to_null(F.col(name))
            for name in ("salary", "seniority_level", "industries", "employment_type", "url")
        },
    })
    return shaped.select(
        "job_id",
        core().alias("core"),
        decision_making().alias("decision_making"),
        description_insights().alias("description_insights"),
        metadata().alias("metadata"),
        full_description().alias("full_description"),
        employment_details(onsite_label=None).alias("employment_details"),
    )
