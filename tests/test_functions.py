"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from vacantia.functions import insights, salary, skills, text, times


def evaluate(spark, value, expression):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("given, low, high, currency, equity", [
    ("$120K - $180K", 120000, 180000, "USD", False),
    ("$150,000 - $200,000", 150000, 200000, "USD", False),
    ("120-180k", 120000, 180000, "USD", False),
    ("$150K", 150000, 150000, "USD", False),
    ("$150K + equity", 150000, 150000, "USD", True),
    ("$200,000/yr + RSU", 200000, 200000, "USD", True),
    ("Base $180K + stock options", 180000, 180000, "USD", True),
    ("€60K - €80K", 60000, 80000, "EUR", False),
    ("£50K - £70K", 50000, 70000, "GBP", False),
    ("¥900 a day", 900, 900, "JPY", False),
    ("€60K or $70K", 60000, 70000, "USD", False),
    ("$200K - $100K - $5K", 100000, 200000, "USD", False),
    ("$120.5K", 120500, 120500, "USD", False),
    ("$50/hr + stock", 50000, 50000, "USD", True),
    ("150000", 0, 150, "USD", False),
    ("Competitive salary", None, None, "USD", False),
    ("N/A", None, None, "USD", False),
    ("", None, None, "USD", False),
    (None, None, None, "USD", False),
])
def test_salary(spark, given, low, high, currency, equity):
    df = spark.createDataFrame([(given,)], "salary string")
    row = salary.with_salary(df).first()
    assert (row.salary_min, row.salary_max) == (low, high)
    assert (row.salary_currency, row.equity_offered) == (currency, equity)


def test_salary_plain_digits(spark):
    df = spark.createDataFrame([("150000 - 90,000",)], "salary string")
    row = salary.with_salary(df, plain_digits=True).first()
    assert (row.salary_min, row.salary_max) == (90000, 150000)


@pytest.mark.parametrize("given, expected", [
    ("Fully Remote within Europe", True), ("You may work from home on Fridays", True),
    ("WFH friendly", True), ("a REMOTE-FIRST team", True), ("Live anywhere you like", True),
    ("distributed databases", True), ("Office attendance on all weekdays", False),
    ("N/A", False), ("", False), (None, False),
])
def test_remote(spark, given, expected):
    assert evaluate(spark, given, text.is_remote) is expected


@pytest.mark.parametrize("given, expected", [
    ("H-1B transfers welcome", True), ("h1b holders too", True),
    ("Includes Visa Support for families", True), ("We can sponsor your permit", True),
    ("A gym, a piano and free lunch", False), ("N/A", False), (None, False),
])
def test_visa(spark, given, expected):
    assert evaluate(spark, given, text.offers_visa) is expected


@pytest.mark.parametrize("given, expected", [
    ("TypeScript or Java; a bit of Python helps, python!", ["Java", "Python", "Typescript"]),
    ("scikit-learn models served with PyTorch", ["Pytorch", "Scikit-Learn"]),
    ("Azure today, GCP tomorrow", ["Azure", "GCP"]),
    ("aws and AWS, ci/cd, Hugging Face", ["AWS", "Aws", "Ci/Cd", "Hugging Face"]),
    ("C++ and JavaScript, Pythonic éGo", ["Javascript"]),
    ("Ability to whistle", []), ("N/A", []), ("", []), (None, []),
])
def test_skills(spark, given, expected):
    assert evaluate(spark, given, skills.skills) == expected


def test_skills_overlapping(spark):
    found = evaluate(spark, "Deep Learning and learning", lambda c: skills.skills(
        c, ["deep learning", "learning"], overlapping=True))
    assert found == ["Deep Learning", "Learning"]


POSTING = """Our group wants a person with 7 years of experience in search.
Deploy rankers written in Rust to Kubernetes on each weekday.
  Create dashboards for recruiters.
create nothing in lower case
Manage a backlog whose description here is long enough that it will be cut at eighty characters.
Lead the fourth line.
PhD degree or similar, please."""


def test_insights(spark):
    df = spark.createDataFrame([(POSTING,)], "raw_description string")
    row = insights.with_insights(df).first()
    assert row.description_summary == POSTING[:300].rsplit(".", 1)[0] + "."
    assert row.key_requirements == ["7+ years experience", "ba", "Kubernetes", "Rust"]
    assert row.key_responsibilities_preview == " • ".join([
        "Deploy rankers written in Rust to Kubernetes on each weekday.",
        "Create dashboards for recruiters.",
        "Manage a backlog whose description here is long enough that it will be cut at eighty characters."[:80],
    ])


@pytest.mark.parametrize("given", ["", "N/A", None])
def test_insights_of_nothing(spark, given):
    df = spark.createDataFrame([(given,)], "raw_description string")
    row = insights.with_insights(df).first()
    assert row.description_summary is None
    assert row.key_requirements == []
    assert row.key_responsibilities_preview is None


@pytest.mark.parametrize("given, expected", [
    ("short.", "short."), ("x" * 301, "x" * 300 + "."), ("a." + "b" * 400, "a."),
    ("q" * 300, "q" * 300),
])
def test_summary(spark, given, expected):
    assert evaluate(spark, given, insights.summary) == expected


@pytest.mark.parametrize("given, expected", [
    ("teams of people", "ms "), ("PhD  degree or so", "PhD  degree"),
    ("Undergraduate degree", "Undergraduate degree"), ("school", None),
])
def test_degree(spark, given, expected):
    assert evaluate(spark, given, insights.degree) == expected


@pytest.mark.parametrize("given, expected", [
    ("Google LLC", "google"), ("Amazon.com, Inc.", "amazon.com"), ("  Acme Corp.  ", "acme"),
    ("Foo, Inc", "foo,"), ("Bar Limited", "bar"), ("Inc.", "inc."), ("A Co. Ltd", "a co."),
    ("\tTabbed, LLC\n", "tabbed"),
])
def test_company(spark, given, expected):
    assert evaluate(spark, given, text.normalize_company) == expected


@pytest.mark.parametrize("given, expected", [
    ("Over 200", 0), ("50-100", 50), ("  7 people", 7), ("-3", -3), ("", 0), (None, None),
])
def test_leading_integer(spark, given, expected):
    assert evaluate(spark, given, text.leading_integer) == expected


@pytest.mark.parametrize("given, expected", [
    ("2026-02-15T10:00:00Z", "2026-02-15 10:00:00"), ("2026-02-15T10:00:00+02:00", "2026-02-15 08:00:00"),
    ("2026-02-15T10:00:00", "2026-02-15 10:00:00"), ("2026-02-15", "2026-02-15 00:00:00"),
    ("2 days ago", None), ("N/A", None), (None, None),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_times(spark, given, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = evaluate(spark, given, lambda c: times.iso_to_utc(c).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == expected


@pytest.mark.parametrize("given, expected", [
    ("Café Ünïcode, don't! x2", ["cafe", "unicode", "don", "t", "x2"]), ("", []), ("—", []),
    ("café", ["cafe"]), ("日本 語", ["日本", "語"]),
])
def test_tokens(spark, given, expected):
    assert evaluate(spark, given, text.tokens) == expected
    assert text.fold_argument(given) == expected


@pytest.mark.parametrize("given, expected", [
    ('["a","b"]', ["a", "b"]), ("A, B", []), ("", []), (None, []), ("[]", []),
])
def test_json_list(spark, given, expected):
    assert evaluate(spark, given, text.json_list) == expected


def test_urn(spark):
    assert evaluate(spark, "urn:li:jobPosting:42", text.last_urn_part) == "42"
    assert evaluate(spark, "other:42", text.last_urn_part) is None
