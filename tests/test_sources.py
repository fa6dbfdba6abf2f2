"""Pages, JSON lines, crawl requests."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from vacantia.operators.filters import quality_gate
from vacantia.plans import answers, ingest, migrate
from vacantia.sources import crawl, html, jsonl, tables

CARD = """
<li><div class="base-card job-search-card" data-entity-urn="urn:li:jobPosting:{id}">
 <a class="base-card__full-link" href="https://jobs.example.com/view/{id}?a=1&amp;b=2">x</a>
 <h3 class="base-search-card__title"> Search <b>Engineer</b> </h3>
 <h4 class="base-search-card__subtitle"><a href="https://example.com/acme">Acme &amp; Co</a></h4>
 <span class="job-search-card__location">San Francisco, CA</span>
 <span class="job-posting-benefits__text">Actively Hiring</span>
 <time class="job-search-card__listdate" datetime="2026-01-29">2 days ago</time>
</div></li>"""

DETAIL = """
<html><head><script>var x = "<h2 class='top-card-layout__title'>no</h2>";</script></head><body>
<h2 class="top-card-layout__title">Search Engineer</h2>
<a class="topcard__org-name-link other" href="https://example.com/acme">Acme, Inc.</a>
<span class="topcard__flavor--bullet">San Francisco, CA</span>
<span class="posted-time-ago__text">2 days ago</span>
<figcaption class="num-applicants__caption">Over 200 applicants</figcaption>
<div class="salary compensation__salary">$160,000 - $180,000</div>
<div class="show-more-less-html__markup"><p>Build remote Python systems.<br>1 < 2 years of exp<!-- c -->
<div>Nested<p>unclosed</div><ul><li>Design AWS things</li></ul></div>
<ul><li class="description__job-criteria-item"><h3>Seniority level</h3><span>Entry level</span></li>
<li class="description__job-criteria-item"><h3>Employment type</h3><span>Full-time</span></li>
<li class="description__job-criteria-item"><h3>Job Function</h3><span>Engineering</span></li>
<li class="description__job-criteria-item"><h3>Industries</h3><span>Old</span></li>
<li class="description__job-criteria-item"><h3>Industries</h3><span>Technology</span></li>
<li class="description__job-criteria-item"><h3>No value</h3></li></ul>
<button aria-label="Press Easy Apply now">go</button></body>"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def test_cards(spark):
    page = CARD.format(id=1) + '<div class="job-search-card"></div>' + CARD.format(id=2)
    rows = html.extract_cards(pages(spark, page, "", None)).orderBy("position").collect()
    assert [(r.job_id, r.position) for r in rows] == [("1", 0), ("2", 2)]
    first = rows[0]
    assert first.title == "Search Engineer" and first.company == "Acme & Co"
    assert first.company_url == "https://example.com/acme"
    assert first.location == "San Francisco, CA" and first.benefits_badge == "Actively Hiring"
    assert (first.posted_date, first.posted_date_iso) == ("2 days ago", "2026-01-29")
    assert first.job_url == "https://jobs.example.com/view/1?a=1&b=2"


def test_detail(spark):
    df = spark.createDataFrame([("7", DETAIL), ("8", "<p>empty</p>")], "job_id string, html string")
    row, empty = html.extract_details(df).orderBy("job_id").collect()
    assert (row.title, row.company, row.location) == ("Search Engineer", "Acme, Inc.", "San Francisco, CA")
    assert row.number_of_applicants == "Over 200 applicants" and "$160,000" in row.salary
    assert row.description_text.split("\n") == [
        "Build remote Python systems.", "1 < 2 years of exp", "Nested", "unclosed", "Design AWS things"]
    assert row.raw_description.startswith('<div class="show-more-less-html__markup"><p>Build')
    assert row.raw_description.endswith("</ul></div>")
    assert row.seniority_level == "Seniority level\nEntry level"
    assert row.employment_type == "Employment type\nFull-time"
    assert row.job_function == "job function\nEngineering"
    assert row.industries == "industries\nTechnology"
    assert row.easy_apply is True
    assert row.posted_date_iso == "2 days ago"
    assert empty.title is None and empty.industries is None and empty.easy_apply is False


def test_ingest_pages(spark):
    cards = html.extract_cards(pages(spark, CARD.format(id=7) + CARD.format(id=7) + CARD.format(id=8)))
    details = html.extract_details(
        spark.createDataFrame([("7", DETAIL), ("8", "<p/>")], "job_id string, html string"))
    rows = ingest.ingest_pages(cards, details, "2026-02-01 00:00:00").collect()
    assert [r.job_id for r in rows] == ["7"]
    row = rows[0]
    assert row.benefits_badge == "Actively Hiring"
    assert str(row.posted_at) == "2026-01-29 00:00:00"
    assert row.normalized_company_name == "acme"
    assert (row.salary_min, row.salary_max) == (160000, 180000)
    assert row.skills == ["AWS", "Python"] and row.remote_eligible and not row.visa_sponsorship
    assert row.key_requirements == ["2+ years experience", "ms", "AWS", "Python"]
    assert row.key_responsibilities_preview == "Build remote Python systems. • Design AWS things"


def test_explore(spark):
    cards = html.extract_cards(pages(spark, CARD.format(id=7) + CARD.format(id=8)))
    details = ingest.enrich(html.extract_details(spark.createDataFrame(
        [("7", DETAIL), ("8", DETAIL), ("9", DETAIL)], "job_id string, html string")), "2026-02-01 00:00:00")
    found = answers.explore(cards, details, "2026-02-01 00:00:00", limit=1)
    assert tuple(found.summary.first()) == (1, 2, 1)
    row = found.jobs.first()
    assert found.jobs.count() == 1 and row.core.job_id == "7"
    assert row.employment_details.workplace_type == "Remote"
    assert row.description_insights.description_summary == row.full_description.description[:500]
    assert answers.explore(cards, details, "2026-02-01 00:00:00", limit=99).summary.first().limit == 99


LEGACY = [
    {"job_id": "1", "title": "Old", "company": "Acme LLC", "location": "SF",
     "scraped_at": "2026-02-15T10:00:00Z", "salary": "$150K", "raw_description": "Remote ML with Python"},
    {"job_id": "2", "title": "Other", "scraped_at": "2026-02-15T11:00:00Z"},
    {"job_id": "1", "title": "New", "company": "Acme LLC"},
]


def test_jsonl_file(spark, tmp_path):
    lines = [json.dumps(LEGACY[0]), "invalid json line", "", "[1]", json.dumps(LEGACY[1])]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    records = jsonl.scan_jsonl(spark, str(tmp_path / "a.jsonl")).cache()
    assert sorted(r.job_id for r in jsonl.accepted(records).collect()) == ["1", "2"]
    assert sorted(r[0] for r in jsonl.rejected(records).collect()) == ["[1]", "invalid json line"]


def test_jsonl_column(spark):
    lines = [json.dumps(LEGACY[0]), "invalid", " ", "[1]", '"text"', "5", '{"job_id": 5, "title": null}']
    records = jsonl.parse_jsonl(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert sorted((r.job_id, r.title) for r in jsonl.accepted(records).collect()) == [("1", "Old"), ("5", None)]
    # The verdict on a line does not depend on the columns a query reads.
    assert jsonl.accepted(records).select("company").count() == 2
    assert sorted(r[0] for r in jsonl.rejected(records).collect()) == ['"text"', "5", "[1]", "invalid"]


def test_migrate_files(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join([*map(json.dumps, LEGACY), "broken"]) + "\n")
    counts = migrate.migrate_files(spark, str(source), str(target), "2026-03-01 00:00:00", 4).first()
    assert (counts.migrated, counts.rejected) == (3, 1)
    rows = {r.job_id: r for r in spark.read.parquet(str(target)).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].title == "New" and str(rows["1"].scraped_at) == "2026-03-01 00:00:00"
    assert rows["2"].company is None and rows["2"].normalized_company_name == "n/a"
    assert rows["2"].posted_date_iso == "2026-02-15T11:00:00Z" and rows["2"].easy_apply is False


def test_migrate_into_an_existing_store(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps({"job_id": str(i), "title": "old", "company": "c"}) for i in range(20)))
    migrate.migrate_files(spark, str(source), str(target), "2026-03-01 00:00:00", 4)
    (source / "a.jsonl").write_text("\n".join(json.dumps({"job_id": str(i), "title": "new", "company": "c"}) for i in (3, 99)))
    migrate.migrate_files(spark, str(source), str(target), "2026-03-02 00:00:00", 4)
    titles = {r.job_id: r.title for r in spark.read.parquet(str(target)).collect()}
    assert titles == {**{str(i): "old" for i in range(20)}, "3": "new", "99": "new"}
    assert spark.read.parquet(str(target)).count() == 21


def test_broken_declaration_does_not_end_the_job(spark):
    pages = spark.createDataFrame([(1, "<![foo bar]>"), (2, "<a href='x'>t</a><![1"), (3, "<![foo")], "page_id long, html string")
    assert html.read_pages(pages, "page_id", "html", (html.CARD_GROUP,)).count() == 3


def test_legacy_flags(spark):
    df = spark.createDataFrame([LEGACY[0]], schema=jsonl.LEGACY)
    row = jsonl.legacy_to_jobs(df, "2026-03-01 00:00:00", default_source="board").first()
    assert row.remote_eligible and row.skills == ["Python"] and row.salary_min == 150000
    assert row.source == "board" and row.profile_id is None and row.benefits_badge is None


def test_crawl_plan(spark):
    profile = spark.createDataFrame(
        [(3, "ml", "SF", 25, "r7200")], "id long, keywords string, location string, distance int, time_filter string")
    rows = crawl.crawl_plan(profile, "https://x.example/s", 2, extra={"f_E": "2"}).orderBy("page").collect()
    assert [r.url for r in rows] == [
        f"https://x.example/s?keywords=ml&location=SF&distance=25&start={s}&f_TPR=r7200&f_E=2" for s in (0, 10)]


def test_live_arguments(spark):
    assert [crawl.pages_for(n) for n in (0, 1, 10, 11, 95, 1000)] == [1, 1, 1, 2, 10, 100]
    df = spark.createDataFrame([(50,), (33,), (None,)], "d int")
    assert [r[0] for r in df.select(crawl.valid_distance(F.col("d"))).collect()] == [50, 25, 25]


def test_gate(spark):
    df = spark.createDataFrame(
        [("1", "t", "c"), ("2", "N/A", "c"), ("3", "t", None), ("N/A", "t", "c")],
        "job_id string, title string, company string")
    counts = Observation()
    assert [r.job_id for r in quality_gate(df, counts=counts).collect()] == ["1"]
    assert counts.get == {"seen": 4, "skipped": 3}


def test_stored_size(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    row = tables.stored_size(spark, str(tmp_path / "t")).first()
    assert row.files >= 1 and row.size_mb >= 0


def test_explore_keeps_card_order_and_repeats(spark):
    cards = html.extract_cards(pages(spark, CARD.format(id=9) + CARD.format(id=7) + CARD.format(id=9) + CARD.format(id=5) + CARD.format(id=8)))
    details = ingest.enrich(html.extract_details(spark.createDataFrame(
        [("7", DETAIL), ("8", DETAIL), ("9", DETAIL)], "job_id string, html string")), "2026-02-01 00:00:00")
    found = answers.explore(cards, details, "2026-02-01 00:00:00", limit=4)
    rows = found.jobs.collect()
    assert [r.core.job_id for r in rows] == ["9", "7", "9"]  # no details for 5
    assert tuple(found.summary.first()) == (3, 5, 4)
    assert all(r.metadata.job_url and r.core.job_id in r.metadata.job_url for r in rows)
