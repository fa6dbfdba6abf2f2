"""Salary text → range, currency and equity flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import mentions_any, present_text


def salary_figures(text: Column, plain_digits: bool = False) -> Column:
    """Whole numbers in text order.

    Any letter k in the text marks figures below 1000 as thousands. ``plain_digits`` reads
    ``150000`` as one figure instead of 150 and 0.
    """
    pattern = C.SALARY_NUMBER_PLAIN_DIGITS if plain_digits else C.SALARY_NUMBER
    thousands = F.contains(F.lower(text), F.lit("k"))

    def figure(raw: Column) -> Column:
        number = F.replace(raw, F.lit(","), F.lit("")).cast("double")
        scaled = F.when(thousands & (number < 1000), number * 1000).otherwise(number)
        return scaled.cast("bigint")

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), figure)


def salary_currency(text: Column) -> Column:
    found = F.lit(C.DEFAULT_CURRENCY)
    for symbol, code in reversed(C.CURRENCY_SYMBOLS):
        found = F.when(F.contains(present_text(text), F.lit(symbol)), code).otherwise(found)
    return found


def offers_equity(text: Column) -> Column:
    return mentions_any(text, C.EQUITY_KEYWORDS)


def with_salary(df: DataFrame, column: str = "salary", plain_digits: bool = False) -> DataFrame:
    """Adds salary_min, salary_max, salary_currency and equity_offered."""
    text = present_text(F.col(column))
    pair = F.slice(salary_figures(text, plain_digits), 1, 2)
    return df.withColumns({
        "salary_min": F.array_min(pair).cast("double"),
        "salary_max": F.array_max(pair).cast("double"),
        "salary_currency": salary_currency(F.col(column)),
        "equity_offered": offers_equity(F.col(column)),
    })
