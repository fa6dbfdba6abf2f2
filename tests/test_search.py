"""Search, pages, full-text conditions, sections, report."""

import datetime as dt
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vacantia.operators import keywords as kw
from vacantia.operators import report, sections, text_index
from vacantia.plans import analytics, answers
from vacantia.plans.search import SearchFilters, count_matches, envelope, matching, search_page
from vacantia.schema import APPLICATIONS, COMPANIES, POSTINGS, PROFILES

NOW = dt.datetime(2026, 2, 20)


def fill(spark, schema, rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def posting(i, **more):
    return {"job_id": str(i), "title": f"Job {i}", "company": "Acme", "normalized_company_name": "acme",
            "location": "San Francisco, CA", "posted_at": NOW - dt.timedelta(hours=i),
            "scraped_at": NOW - dt.timedelta(hours=i), "raw_description": "text", **more}


@pytest.fixture(scope="module")
def tables(spark):
    jobs = fill(spark, POSTINGS, [
        posting(1, remote_eligible=True, number_of_applicants="Over 200", salary="$1"),
        posting(2, company="Google LLC", normalized_company_name="google", visa_sponsorship=True,
                number_of_applicants="50-100", raw_description="Rust at 100%", remote_eligible=True),
        posting(3, location="New York", number_of_applicants="9", skills=["Python", "AWS"],
                benefits_badge="Hiring", posted_at=None),
        posting(4, location="100%_off", raw_description="Café node.js and C++"),
        posting(800, company="Big Google Inc", normalized_company_name="big google"),
    ])
    applications = fill(spark, APPLICATIONS, [
        {"job_id": "2", "status": "applied", "applied_at": NOW, "notes": "hello"},
        {"job_id": "3", "status": "rejected", "applied_at": NOW - dt.timedelta(days=1)},
        {"job_id": "gone", "status": "strange", "applied_at": NOW},
    ])
    companies = fill(spark, COMPANIES, [
        {"company_name": "Google", "normalized_company_name": "google", "company_size": "many",
         "company_specialties": ["x"], "next_refresh_at": NOW - dt.timedelta(days=1)},
    ])
    return jobs, applications, companies


@pytest.mark.parametrize("wanted, ids", [
    (SearchFilters(), "1 2 3 4 800"), (SearchFilters(company="GOOGLE, Inc."), "2 800"),
    (SearchFilters(location="san fran"), "1 2 800"), (SearchFilters(location="%"), "4"),
    (SearchFilters(location="0%_o"), "4"), (SearchFilters(remote_only=True), "1 2"),
    (SearchFilters(visa_sponsorship=True), "2"), (SearchFilters(posted_after_hours=2), "1 2"),
    (SearchFilters(posted_after_hours=0), "1 2 3 4 800"), (SearchFilters(application_status="applied"), "2"),
    (SearchFilters(application_status="not_applied"), "1 4 800"), (SearchFilters(keywords="rust"), "2"),
    (SearchFilters(keywords="cafe"), "4"), (SearchFilters(keywords="node.js"), "4"),
    (SearchFilters(keywords="python"), "3"), (SearchFilters(keywords="pythons"), ""),
    (SearchFilters(company="google", remote_only=True, keywords="rust", application_status="applied"), "2"),
])
@pytest.mark.parametrize("indexed", [False, True])
def test_filters(spark, tables, wanted, ids, indexed):
    jobs, applications, _ = tables
    index = text_index.build_index(jobs) if indexed and wanted.keywords else None
    found = matching(jobs, applications, wanted, NOW, index)
    assert sorted(int(r.job_id) for r in found.select("job_id").collect()) == [int(i) for i in ids.split()]
    total = count_matches(jobs, applications, wanted, NOW, index).first().total
    assert total == len(ids.split())


@pytest.mark.parametrize("sort_by, ids", [
    ("posted_date", "1 2 4 800 3"), ("scraped_at", "1 2 3 4 800"), ("applicants", "2 3 1 4 800"),
    ("anything", "1 2 4 800 3"),
])
def test_pages(tables, sort_by, ids):
    for limit, offset in [(10, 0), (2, 0), (2, 1), (3, 4), (2, 9)]:
        rows = search_page(*tables, SearchFilters(), NOW, sort_by, limit, offset).collect()
        assert [r.job_id for r in rows] == ids.split()[offset:offset + limit]


def test_page_columns(tables):
    row = search_page(*tables, SearchFilters(company="google"), NOW, limit=1).first()
    assert (row.application_status, row.notes, row.company_size) == ("applied", "hello", "many")


def test_envelope(tables):
    jobs, applications, _ = tables
    assert tuple(envelope(jobs, applications, SearchFilters(), NOW, 2, 4).first()) == (1, 5, 2)
    assert tuple(envelope(jobs, applications, SearchFilters(), NOW, 2, 9).first()) == (0, 5, 2)


# ---- full text against a plain model --------------------------------------------------------

WORDS = ["ab", "abc", "b", "c", "d"]


def model(doc, atom):
    for name, text in doc.items():
        if not atom.covers(name):
            continue
        toks = re.findall(r"[a-z]+", text)
        spots = [i for i in range(len(toks))]
        if atom.gap is not None:
            places = [[i for i in spots if toks[i] == w] for w in atom.words]
            if any(max(c) - min(c) <= atom.gap + 1 for c in itertools.product(*places)):
                return True
            continue
        n = len(atom.words)
        for i in range(len(toks) - n + 1):
            run = toks[i:i + n]
            last = run[-1].startswith(atom.words[-1]) if atom.prefix else run[-1] == atom.words[-1]
            if run[:-1] == list(atom.words[:-1]) and last:
                return True
    return False


def holds(doc, c):
    if isinstance(c, kw.Both):
        return holds(doc, c.left) and holds(doc, c.right)
    if isinstance(c, kw.Either):
        return holds(doc, c.left) or holds(doc, c.right)
    if isinstance(c, kw.Not):
        return not holds(doc, c.inner)
    return model(doc, c)


CONDITIONS = [
    "ab", "ab b", '"ab b"', "a*", '"b a*"', "title:ab", 'body:"c d"', "ab OR c", "ab NOT c",
    "NEAR(ab c, 2)", "NEAR(ab c d, 3)", "NEAR(b b, 1)", "ab b NOT c d", "ab OR b NOT c",
    "ab AND b NOT c OR d", '"a" OR "b c d"', "NEAR(ab d) NOT abc",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs = {
        str(i): {"title": " ".join(rng.choices(WORDS, k=rng.randrange(4))),
                 "body": " ".join(rng.choices(WORDS, k=rng.randrange(14)))}
        for i in range(150)
    }
    df = spark.createDataFrame([(k, d["title"], d["body"]) for k, d in docs.items()],
                               "job_id string, title string, body string").cache()
    return docs, df


@pytest.mark.parametrize("line", CONDITIONS)
def test_conditions(corpus, line):
    docs, df = corpus
    condition = kw.from_text(line)
    expected = sorted(k for k, d in docs.items() if holds(d, condition))
    fields = ["title", "body"]
    scanned = kw.search_scan(df, condition, fields=fields)
    indexed = kw.search_index(text_index.build_index(df, fields=fields), condition)
    adhoc = kw.search_index(text_index.build_index(df, fields=fields, only=condition), condition)
    assert sorted(r[0] for r in scanned.collect()) == expected
    assert sorted(r[0] for r in indexed.collect()) == expected
    assert sorted(r[0] for r in adhoc.collect()) == expected


def test_negative_condition_needs_all_keys(corpus):
    docs, df = corpus
    condition = ~kw.word("ab")
    index = text_index.build_index(df, fields=["title", "body"])
    expected = sorted(k for k, d in docs.items() if holds(d, condition))
    found = kw.search_index(index, condition, everything=df)
    assert sorted(r[0] for r in found.collect()) == expected


def test_line_grammar():
    assert kw.from_text("C++") == kw.Atom(("c",))
    assert kw.from_text("don't") == kw.Atom(("don", "t"))
    assert kw.from_text("a or b").atoms() == [kw.Atom(("a",)), kw.Atom(("or",)), kw.Atom(("b",))]
    assert kw.from_text('"a OR b"') == kw.Atom(("a", "or", "b"))
    with pytest.raises(ValueError):
        kw.from_text("  ")
    with pytest.raises(ValueError):
        kw.from_text("++")


def test_index_follows_updates(spark, corpus, tmp_path):
    _, df = corpus
    fields = ["title", "body"]
    index = text_index.build_index(df, fields=fields)
    touched = df.filter("job_id = '5'").withColumn("body", F.lit("fresh words"))
    after = text_index.refresh_index(index, touched, fields=fields)
    text_index.write_index(after, str(tmp_path / "index"), 4)
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert [r[0] for r in kw.search_index(stored, kw.word("fresh")).collect()] == ["5"]
    gone = text_index.drop_from_index(after, touched)
    assert kw.search_index(gone, kw.word("fresh")).count() == 0


# ---- sections and report --------------------------------------------------------------------

def test_sections_json(tables):
    page = search_page(*tables, SearchFilters(company="google"), NOW, limit=1)
    made = json.loads(sections.as_json(sections.with_sections(page, sections.SECTIONS)).first().response)
    assert made["core"] == {"job_id": "2", "title": "Job 2", "company": "Google LLC",
                            "location": "San Francisco, CA"}
    assert made["decision_making"]["easy_apply"] is False
    assert made["application_tracking"]["application_notes"] == "hello"
    assert made["company_enrichment"] == {"company_size": "many", "company_specialties": ["x"]}
    assert made["complete_skills"] == {"skills_required": [], "skills_preferred": []}
    assert made["benefits"] == {"benefits": []}
    assert made["employment_details"]["workplace_type"] == "Remote"


def test_query_jobs(tables):
    answer = answers.query_jobs(*tables, SearchFilters(remote_only=True), NOW, ["metadata"], limit=1)
    assert [r.job_id for r in answer.jobs.collect()] == ["1"]
    assert answer.jobs.columns == ["job_id", "core", "decision_making", "metadata"]
    assert tuple(answer.summary.first()) == (1, 2, 1)


def test_sections_default_and_unknown(tables):
    page = search_page(*tables, SearchFilters(application_status="not_applied"), NOW, limit=1)
    assert sections.with_sections(page).columns == [
        "job_id", "core", "decision_making", "description_insights"]
    tracked = sections.with_sections(page, ["application_tracking"]).first()
    assert tracked.application_tracking is None
    with pytest.raises(ValueError):
        sections.with_sections(page, ["nope"])


def test_age_buckets(spark):
    hours = [12, 3 * 24, 15 * 24, 40 * 24]
    df = spark.createDataFrame([(NOW - dt.timedelta(hours=h),) for h in hours], "scraped_at timestamp_ntz")
    row = report.age_counts(df, NOW).first()
    assert (row.fresh_24h, row.recent_7d, row.old_30d, row.stale) == (1, 2, 3, 1)


def test_report(spark, tables):
    jobs, applications, companies = tables
    profiles = fill(spark, PROFILES, [{"id": 1, "name": "p", "refresh_interval": 7200, "enabled": True,
                                       "last_scraped_at": NOW}])
    long_form = analytics.analytics_report(jobs, profiles, applications, companies, NOW)
    figures = {(r.section, r.metric): r.value for r in long_form.collect()}
    assert figures["jobs", "total"] == "5" and figures["jobs.by_age", "stale"] == "1"
    assert figures["jobs.by_application_status", "not_applied"] == "3"
    assert figures["applications", "total"] == "3" and figures["applications", "accepted"] == "0"
    assert figures["jobs.top_companies", "acme"] == "3"
    assert figures["company_enrichment", "needing_refresh"] == "1"
    nested = {r.section: json.loads(r.figures) for r in analytics.nested_report(long_form).collect()}
    assert nested["jobs.top_locations"]["San Francisco, CA"] == "3"
    health = report.profile_health(profiles, jobs).first()
    assert health.refresh_interval_hours == 2.0
    assert health.next_scrape_at == NOW + dt.timedelta(hours=2)
