"""Skill mentions in prose."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import present_text


def _title_case(text: Column) -> Column:
    """Capital first letter in every run of letters (``scikit-learn`` → ``Scikit-Learn``)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def skill_label(match: Column) -> Column:
    """Short all-capital acronyms keep their case, everything else gets title case."""
    acronym = (match == F.upper(match)) & (match != F.lower(match)) & (F.length(match) <= 4)
    return F.when(acronym, match).otherwise(_title_case(match))


def skills(
    description: Column,
    patterns: Iterable[str] = C.SKILL_PATTERNS,
    overlapping: bool = False,
) -> Column:
    """Distinct skill labels in code-point order.

    The default reads the text once with all patterns joined. Pass ``overlapping=True`` for a
    dictionary where one entry may match inside another; it reads the text once per entry.
    """
    entries = list(patterns)
    groups = entries if overlapping else ["|".join(entries)]
    text = present_text(description)
    found = [
        F.regexp_extract_all(text, F.lit(rf"(?iU)\b({group})\b"), F.lit(1)) for group in groups
    ]
    matches = found[0] if len(found) == 1 else F.flatten(F.array(*found))
    labels = F.array_sort(F.array_distinct(F.transform(F.array_distinct(matches), skill_label)))
    return F.coalesce(labels, F.array().cast("array<string>"))
