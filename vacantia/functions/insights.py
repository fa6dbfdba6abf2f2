"""Summary, requirements and responsibilities of a description."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.skills import skills
from vacantia.functions.text import present_text, strip


def summary(text: Column, limit: int = 300) -> Column:
    """The whole text when short, else its head cut back to the last full stop."""
    head = F.regexp_replace(F.substring(text, 1, limit), r"\.[^.]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(".")))


def years_of_experience(text: Column) -> Column:
    years = F.nullif(F.regexp_extract(text, C.YEARS_PATTERN, 1), F.lit(""))
    return F.concat(years, F.lit("+ years experience"))


def degree(text: Column) -> Column:
    return F.coalesce(
        *[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in C.DEGREE_PATTERNS]
    )


def requirements(text: Column, skill_list: Column, top: int = 5) -> Column:
    """Years, degree, then the first skills; an empty list when nothing is found."""
    facts = F.array_compact(F.array(years_of_experience(text), degree(text)))
    return F.concat(facts, F.slice(skill_list, 1, top))


def responsibilities(
    text: Column,
    verbs: Iterable[str] = C.RESPONSIBILITY_VERBS,
    keep: int = 3,
    width: int = 80,
) -> Column:
    """First lines that open with one of the verbs, shortened and joined; NULL when none."""
    opening = "^(?:" + "|".join(re.escape(v) for v in verbs) + ")"
    lines = F.transform(F.split(text, "\n"), strip)
    chosen = F.slice(F.filter(lines, lambda line: line.rlike(opening)), 1, keep)
    short = F.transform(chosen, lambda line: F.substring(line, 1, width))
    return F.nullif(F.array_join(short, " • "), F.lit(""))


def with_insights(
    df: DataFrame, column: str = "raw_description", skills_column: str | None = None
) -> DataFrame:
    """Adds description_summary, key_requirements and key_responsibilities_preview.

    Give ``skills_column`` when the skills were extracted before, so they are not read twice.
    """
    text = present_text(F.col(column))
    found = F.col(skills_column) if skills_column else skills(text)
    empty = F.array().cast("array<string>")
    return df.withColumns({
        "description_summary": summary(text),
        "key_requirements": F.when(text.isNull(), empty).otherwise(requirements(text, found)),
        "key_responsibilities_preview": responsibilities(text),
    })
