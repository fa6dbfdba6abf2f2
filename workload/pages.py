"""S: readers over pages, JSON lines, tables and crawl requests; X20."""

from pyspark.sql import functions as F

from vacantia import work_dir
from vacantia.sources import crawl, html, jsonl, tables
from vacantia.plans.migrate import migrated
from workload.bindings import AS_OF, ctes, norm_sql, table, view
from workload.registry import query

# Text of a markup fragment in DuckDB: drop comments, cut at tags, decode, strip, join.
def _decode(expr: str) -> str:
    for code, letter in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        expr = f"replace({expr}, '{code}', '{letter}')"
    return expr


def _text_sql(fragment: str, joiner: str) -> str:
    node = rf"regexp_replace({_decode('n')}, '^\s+|\s+$', '', 'g')"
    return rf"""array_to_string(list_filter(list_transform(
      string_split_regex(regexp_replace({fragment}, '<!--.*?-->', '<c>', 'gs'), '<[^>]*>'),
      lambda n: {node}), lambda n: n <> ''), {joiner})"""


ANCHOR = html.Group("anchors", (html.Field("href", "a", attr="href"), html.Field("text", "a")), tag="a")
HEAD = html.Group("head", (
    html.Field("title", "title"), html.Field("h1", "h1"), html.Field("lang", "html", attr="lang"),
))

ANCHOR_SQL = f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, {_decode('hrefs[i]')} AS href,
  trim({_decode('texts[i]')}) AS text
FROM (SELECT page_id, hrefs, texts, unnest(range(1, len(hrefs) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages))"""

HEAD_SQL = rf"""
SELECT page_id,
  regexp_replace({_decode("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '^\s+|\s+$', '', 'g') AS title,
  regexp_replace({_decode("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '^\s+|\s+$', '', 'g') AS h1,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
FROM pages"""


def anchors(spark, sf):
    return html.extract_group(table(spark, sf, "pages"), "page_id", "html", ANCHOR)


def page_heads(spark, sf):
    return html.extract_group(table(spark, sf, "pages"), "page_id", "html", HEAD).drop("position")


@query("s1_scan_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    layout = (StructType().add("o_orderkey", LongType()).add("o_orderstatus", StringType())
              .add("o_totalprice", DoubleType()))
    return tables.scan_table(spark, f"{sf}/orders.parquet", schema=layout)


def _lines(spark, sf):
    """All documents as JSON lines, and beside them lines that are broken, a list, or blank."""
    record = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("job_id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("company"), F.col("text").alias("raw_description"),
        F.when(F.col("doc_id") % 8 == 0, "$120K - $180K").when(F.col("doc_id") % 8 == 1, "€60K + stock")
        .when(F.col("doc_id") % 8 == 2, "N/A").alias("salary"),
        F.lit("2024-01-15T10:00:00Z").alias("scraped_at")))
    kind = F.col("doc_id") % 10
    odd = (F.when(kind == 7, F.concat(F.lit("broken {"), F.col("doc_id").cast("string")))
           .when(kind == 8, "[1]").when(kind == 9, "  "))
    documents = table(spark, sf, "documents")
    return documents.select("doc_id", record.alias("line")).unionByName(
        documents.select("doc_id", odd.alias("line")).filter("line IS NOT NULL"))


@query("s2_jsonl_accepted", """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS job_id, split_part(text, chr(10), 1) AS title, text AS raw_description
FROM documents""")
def _(spark, sf):
    return jsonl.accepted(jsonl.parse_jsonl(_lines(spark, sf), "line")).select(
        "doc_id", "job_id", "title", "raw_description")


@query("s2_jsonl_rejected", """
SELECT CASE WHEN doc_id % 10 = 7 THEN 'broken {' || CAST(doc_id AS VARCHAR) ELSE '[1]' END AS _corrupt_record
FROM documents WHERE doc_id % 10 IN (7, 8)""")
def _(spark, sf):
    return jsonl.rejected(jsonl.parse_jsonl(_lines(spark, sf), "line"))


_LEGACY_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS job_id, split_part(text, chr(10), 1) AS title, source AS company,
  {norm_sql('source')} AS normalized_company_name,
  '2024-01-15T10:00:00Z' AS posted_date_iso, TIMESTAMP '2024-01-15 10:00:00' AS posted_at,
  CASE doc_id % 8 WHEN 0 THEN 120000.0 WHEN 1 THEN 60000.0 END::DOUBLE AS salary_min,
  CASE doc_id % 8 WHEN 0 THEN 180000.0 WHEN 1 THEN 60000.0 END::DOUBLE AS salary_max,
  CASE doc_id % 8 WHEN 1 THEN 'EUR' ELSE 'USD' END AS salary_currency,
  doc_id % 8 = 1 AS equity_offered,
  regexp_matches(lower(text), 'remote|work from home|wfh|distributed|anywhere') AS remote_eligible,
  regexp_matches(lower(text), 'visa sponsorship|h1b|h-1b|work authorization|sponsorship available|sponsor visa|visa support|eligible for visa|can sponsor') AS visa_sponsorship,
  false AS easy_apply, text AS raw_description
FROM documents"""
_LEGACY_OUT = [
    "job_id", "title", "company", "normalized_company_name", "posted_date_iso", "posted_at",
    "salary_min", "salary_max", "salary_currency", "equity_offered", "remote_eligible",
    "visa_sponsorship", "easy_apply", "raw_description",
]


@query("s3_legacy_to_jobs", _LEGACY_SQL)
def _(spark, sf):
    good = jsonl.accepted(jsonl.parse_jsonl(_lines(spark, sf), "line"))
    return jsonl.legacy_to_jobs(good, AS_OF).select(*_LEGACY_OUT)


@query("k11_migrate_jsonl", _LEGACY_SQL)
def _(spark, sf):
    """The lines are written as text files and read back, then shaped and merged."""
    folder = work_dir(spark, "jsonl")
    _lines(spark, sf).select("line").write.text(folder)
    records = jsonl.scan_jsonl(spark, folder).withColumn("_seq", F.monotonically_increasing_id())
    return migrated(records, AS_OF, "_seq").select(*_LEGACY_OUT)


@query("s4_extract_cards", ANCHOR_SQL)
def _(spark, sf):
    return anchors(spark, sf)


@query("s5_extract_details", rf"""
SELECT h.page_id, h.title, h.h1, h.lang,
  {_text_sql("regexp_extract(p.html, '<article>(.*?)</article>', 1, 's')", "' '")} AS article
FROM ({HEAD_SQL}) h JOIN pages p ON h.page_id = p.page_id""")
def _(spark, sf):
    group = html.Group("detail", (*HEAD.fields, html.Field("article", "article")))
    return html.extract_group(table(spark, sf, "pages"), "page_id", "html", group).drop("position")


_CRITERIA = (("has_th", "th", False), ("has_en", "en", False), ("has_er", "er", True), ("has_a", "a", True))


@query("s6_criteria_pivot", f"""
WITH a AS ({ANCHOR_SQL}),
b AS (SELECT page_id, position, text, href, CASE WHEN contains(lower(text), 'th') THEN 'has_th'
  WHEN contains(lower(text), 'en') THEN 'has_en' WHEN contains(lower(text), 'er') THEN 'has_er'
  WHEN contains(lower(text), 'a') THEN 'has_a' END AS bucket FROM a)
SELECT p.page_id,
  max_by(text || chr(10) || href, position) FILTER (bucket = 'has_th') AS has_th,
  max_by(text || chr(10) || href, position) FILTER (bucket = 'has_en') AS has_en,
  max_by(lower(text) || chr(10) || href, position) FILTER (bucket = 'has_er') AS has_er,
  max_by(lower(text) || chr(10) || href, position) FILTER (bucket = 'has_a') AS has_a
FROM pages p LEFT JOIN b ON p.page_id = b.page_id GROUP BY p.page_id""")
def _(spark, sf):
    group = html.Group(
        "criteria", (html.Field("label", "a"), html.Field("value", "a", attr="href")), tag="li")
    read = html.read_pages(table(spark, sf, "pages"), "page_id", "html", (group,))
    pivoted = html.pivot_criteria(F.col("criteria"), _CRITERIA)
    return read.select("page_id", *[column.alias(name) for name, column in pivoted.items()])


@query("s7_element_flag", """
SELECT page_id, contains(html, '<div class="ad">') AS has_button,
  contains(html, '<div class="aside">') AS has_label FROM pages""")
def _(spark, sf):
    group = html.Group("flags", (html.Field("apply_button", classes=("ad",)),
                                 html.Field("apply_label", "div", ("aside",))))
    read = html.read_pages(table(spark, sf, "pages"), "page_id", "html", (group,))
    flags = F.col("flags")[0]
    return read.select(
        "page_id", flags["apply_button"].isNotNull().alias("has_button"),
        flags["apply_label"].isNotNull().alias("has_label"))


@query("s8_crawl_plan", ctes("profiles") + """
SELECT id AS profile_id, CAST(page AS INTEGER) AS page, CAST(page * 10 AS INTEGER) AS start,
  'https://jobs.example.com/search?keywords=' || keywords || '&location=' || location
  || '&distance=' || CAST(distance AS VARCHAR) || '&start=' || CAST(page * 10 AS VARCHAR)
  || '&f_TPR=' || time_filter || '&f_E=2' AS url
FROM profiles, range(0, 5) r(page) WHERE enabled""")
def _(spark, sf):
    profiles = view(spark, sf, "profiles").filter("enabled")
    return crawl.crawl_plan(profiles, "https://jobs.example.com/search", 5, extra={"f_E": "2"})


@query("s8_detail_requests", """
SELECT CAST(doc_id AS VARCHAR) AS job_id, 'https://jobs.example.com/posting/' || CAST(doc_id AS VARCHAR) AS url
FROM documents""")
def _(spark, sf):
    return crawl.detail_requests(
        view(spark, sf, "jobs").select("job_id"), "https://jobs.example.com/posting")


@query("x20_page_text", rf"""
SELECT page_id, {_text_sql("regexp_extract(html, '<body>(.*)', 1, 's')", "chr(10)")} AS text FROM pages""")
def _(spark, sf):
    group = html.Group("page", (html.Field("text", "body", joiner="\n"),))
    return html.extract_group(table(spark, sf, "pages"), "page_id", "html", group).drop("position")


@query("a12_stored_size")
def _(spark, sf):
    return tables.stored_size(spark, sf)
