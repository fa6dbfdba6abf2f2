"""X: column functions as jobs over whole tables."""

from pyspark.sql import functions as F

from vacantia.functions import insights, salary, skills, text, times
from vacantia.operators import report
from workload.bindings import AS_OF, ctes, norm_sql, table, view
from workload.registry import query

# Words the test documents contain, in place of the default dictionaries.
WORDS = ("the", "and", "tion", "que", "der", "los", "thing")
_FOUND = r"""list_sort(list_distinct(list_transform(list_filter(
  string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: lower(w) IN ('the','and','tion','que','der','los','thing')),
  lambda w: CASE WHEN w = upper(w) AND w <> lower(w) AND len(w) <= 4 THEN w
    ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END)))"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("x1_normalize_company", f"""
SELECT doc_id, {norm_sql('name')} AS normalized FROM (SELECT doc_id,
  '  ' || upper(source) || CASE doc_id % 8 WHEN 0 THEN ', Inc' WHEN 1 THEN ', LLC' WHEN 2 THEN ' CORPORATION'
  WHEN 3 THEN ' Limited ' WHEN 4 THEN ', Co.' WHEN 5 THEN ' Co' WHEN 6 THEN ', Ltd. Inc.' ELSE '' END AS name FROM documents)""")
def _(spark, sf):
    kind = F.col("doc_id") % 8
    tail = (F.when(kind == 0, ", Inc").when(kind == 1, ", LLC").when(kind == 2, " CORPORATION")
            .when(kind == 3, " Limited ").when(kind == 4, ", Co.").when(kind == 5, " Co")
            .when(kind == 6, ", Ltd. Inc.").otherwise(""))
    name = F.concat(F.lit("  "), F.upper("source"), tail)
    return _docs(spark, sf).select("doc_id", text.normalize_company(name).alias("normalized"))


_NUMS = r"""list_transform(list_transform(
  regexp_extract_all({t}, '[\$£€¥]?\s*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?)\s*[Kk]?', 1),
  lambda s: CAST(replace(s, ',', '') AS DOUBLE)),
  lambda v: CAST(trunc(CASE WHEN contains(lower({t}), 'k') AND v < 1000 THEN v * 1000 ELSE v END) AS BIGINT))"""


def _salary_sql(source: str, column: str, key: str) -> str:
    nums = _NUMS.format(t="t")
    return f"""
SELECT {key}, CAST(list_min(n[1:2]) AS DOUBLE) AS salary_min, CAST(list_max(n[1:2]) AS DOUBLE) AS salary_max
FROM (SELECT {key}, {nums} AS n FROM (SELECT {key}, nullif(nullif({column}, 'N/A'), '') AS t FROM {source}))"""


@query("x2_salary_range", ctes("jobs") + _salary_sql("jobs", "salary", "job_id"))
def _(spark, sf):
    jobs = view(spark, sf, "jobs").select("job_id", "salary")
    return salary.with_salary(jobs).select("job_id", "salary_min", "salary_max")


@query("x2_salary_range_in_prose", _salary_sql("documents", "text", "doc_id"))
def _(spark, sf):
    return salary.with_salary(_docs(spark, sf), "text").select("doc_id", "salary_min", "salary_max")


@query("x2_salary_plain_digits", ctes("jobs") + """
SELECT job_id, CASE WHEN salary = '150000' THEN 150000.0 WHEN salary LIKE '$120K%' THEN 120000.0
  WHEN salary LIKE '€60K%' THEN 60000.0 WHEN salary LIKE '$150,000%' THEN 150000.0
  WHEN salary LIKE '£%' THEN least(CAST(regexp_extract(salary, '£(\\d+)K', 1) AS DOUBLE) * 1000,
    CAST(regexp_extract(salary, '- £(\\d+)', 1) AS DOUBLE) * 1000 + 500) END::DOUBLE AS salary_min
FROM jobs""".replace("\\\\", "\\"))
def _(spark, sf):
    jobs = view(spark, sf, "jobs").select("job_id", "salary")
    return salary.with_salary(jobs, plain_digits=True).select("job_id", "salary_min")


@query("x3_salary_currency", ctes("jobs") + """
SELECT job_id, CASE WHEN contains(salary, '$') THEN 'USD' WHEN contains(salary, '£') THEN 'GBP'
  WHEN contains(salary, '€') THEN 'EUR' WHEN contains(salary, '¥') THEN 'JPY' ELSE 'USD' END AS currency FROM jobs""")
def _(spark, sf):
    return view(spark, sf, "jobs").select(
        "job_id", salary.salary_currency(F.col("salary")).alias("currency"))


@query("x4_equity_flag", """
SELECT doc_id, regexp_matches(lower(text), 'equity|stock options|rsu|options|stock') AS equity FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", salary.offers_equity(F.col("text")).alias("equity"))


@query("x5_remote_flag", """
SELECT doc_id, regexp_matches(lower(text), 'thing|ering|que') AS custom,
  regexp_matches(lower(text), 'remote|work from home|wfh|distributed|anywhere') AS remote FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", text.is_remote(F.col("text"), ("thing", "ering", "que", "nothing")).alias("custom"),
        text.is_remote(F.col("text")).alias("remote"))


@query("x6_visa_flag", """
SELECT doc_id, regexp_matches(lower(text), 'and the|der ') AS custom,
  regexp_matches(lower(text), 'visa sponsorship|h1b|h-1b|work authorization|sponsorship available|sponsor visa|visa support|eligible for visa|can sponsor') AS visa
FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", text.offers_visa(F.col("text"), ("and the", "der ")).alias("custom"),
        text.offers_visa(F.col("text")).alias("visa"))


@query("x7_skills", f"SELECT doc_id, array_to_string({_FOUND}, '|') AS skills FROM documents")
def _(spark, sf):
    found = skills.skills(F.col("text"), WORDS)
    return _docs(spark, sf).select("doc_id", F.array_join(found, "|").alias("skills"))


@query("x8_summary", r"""
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text
  ELSE regexp_replace(substring(text, 1, 300), '\.[^.]*$', '') || '.' END AS summary FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", insights.summary(F.col("text")).alias("summary"))


@query("x9_years", ctes("jobs") + r"""
SELECT job_id, nullif(regexp_extract(t, '(?i)(\d+)\+?\s*years?\s*(of\s*)?(experience|exp)', 1), '') || '+ years experience' AS years
FROM (SELECT job_id, title || ' ' || profile_id || ' Years of EXP ' || raw_description AS t FROM jobs)""")
def _(spark, sf):
    body = F.concat(F.col("title"), F.lit(" "), F.col("profile_id").cast("string"),
                    F.lit(" Years of EXP "), F.col("raw_description"))
    return view(spark, sf, "jobs").select("job_id", insights.years_of_experience(body).alias("years"))


@query("x10_degree", r"""
SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)(MS|Master|PhD|Doctorate|Bachelor|BS|BA)\s*(degree)?', 0), ''),
  nullif(regexp_extract(text, '(?i)(Graduate|Undergraduate)\s*degree', 0), '')) AS degree FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", insights.degree(F.col("text")).alias("degree"))


@query("x11_requirements", rf"""
SELECT doc_id, array_to_string(list_concat(list_filter([
  nullif(regexp_extract(text, '(?i)(\d+)\+?\s*years?\s*(of\s*)?(experience|exp)', 1), '') || '+ years experience',
  nullif(regexp_extract(text, '(?i)(MS|Master|PhD|Doctorate|Bachelor|BS|BA)\s*(degree)?', 0), '')],
  lambda v: v IS NOT NULL), ({_FOUND})[1:5]), '|') AS requirements FROM documents""")
def _(spark, sf):
    body = F.col("text")
    listed = insights.requirements(body, skills.skills(body, WORDS))
    return _docs(spark, sf).select("doc_id", F.array_join(listed, "|").alias("requirements"))


@query("x12_responsibilities", r"""
SELECT doc_id, nullif(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
  lambda s: regexp_matches(s, '^(The|And|En|De)'))[1:3], lambda s: substring(s, 1, 80)), ' • '), '') AS preview
FROM documents""")
def _(spark, sf):
    preview = insights.responsibilities(F.col("text"), ("The", "And", "En", "De"))
    return _docs(spark, sf).select("doc_id", preview.alias("preview"))


@query("x13_leading_integer", r"""
SELECT o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS priority,
  coalesce(try_cast(regexp_extract(o_orderstatus, '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS none FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", text.leading_integer(F.col("o_orderpriority")).alias("priority"),
        text.leading_integer(F.col("o_orderstatus")).alias("none"))


@query("x14_json_list", """
SELECT event_id, '["' || event_type || '","b"]' AS as_text,
  CASE WHEN event_id % 2 = 0 THEN event_type || '|' || CAST(user_id AS VARCHAR) ELSE '' END AS items FROM events""")
def _(spark, sf):
    good = F.to_json(F.array(F.col("event_type"), F.col("user_id").cast("string")))
    stored = F.when(F.col("event_id") % 2 == 0, good).otherwise(
        F.concat(F.col("event_type"), F.lit(", B")))
    return table(spark, sf, "events").select(
        "event_id", F.to_json(F.array(F.col("event_type"), F.lit("b"))).alias("as_text"),
        F.array_join(text.json_list(stored), "|").alias("items"))


@query("x15_missing_marker", ctes("jobs") + """
SELECT job_id, nullif(salary, 'N/A') AS salary, coalesce(employment_type, 'N/A') AS employment_type FROM jobs""")
def _(spark, sf):
    return view(spark, sf, "jobs").select(
        "job_id", text.na_to_null(F.col("salary")).alias("salary"),
        text.null_to_na(F.col("employment_type")).alias("employment_type"))


@query("x16_iso_times", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - to_hours(2)
  WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP END AS at FROM events""")
def _(spark, sf):
    kind = F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = (F.when(kind == 0, F.concat(stamp, F.lit("Z"))).when(kind == 1, F.concat(stamp, F.lit("+02:00")))
           .when(kind == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("2 days ago"))
    return table(spark, sf, "events").select("event_id", times.iso_to_utc(iso).alias("at"))


@query("x17_intervals", """
SELECT event_id, ts + to_seconds(user_id * 60) AS later, ts + to_days(30) AS refresh,
  ts - to_hours(user_id) AS earlier FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", times.seconds_after(F.col("ts"), F.col("user_id") * 60).alias("later"),
        times.days_after(F.col("ts"), 30).alias("refresh"),
        times.hours_before(F.col("ts"), F.col("user_id").cast("int")).alias("earlier"))


@query("x18_hours_and_megabytes", """
SELECT doc_id, n_chars / 3600.0::DOUBLE AS hours, round(n_chars * 1000.0::DOUBLE / 1048576.0::DOUBLE, 2) AS mb FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", times.seconds_to_hours(F.col("n_chars")).alias("hours"),
        times.bytes_to_mb(F.col("n_chars") * F.lit(1000.0)).alias("mb"))


@query("x19_urn_id", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) END AS job_id,
  string_split(url, '/')[-1] AS last_part FROM pages""")
def _(spark, sf):
    urn = F.concat(F.when(F.col("page_id") % 3 == 0, "urn:other:").otherwise("urn:li:jobPosting:"),
                   F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select(
        "page_id", text.last_urn_part(urn).alias("job_id"),
        F.element_at(F.split("url", "/"), -1).alias("last_part"))


@query("x21_skill_counts", f"""
SELECT skill, count(*) AS jobs FROM (SELECT unnest({_FOUND}) AS skill FROM documents) GROUP BY skill""")
def _(spark, sf):
    return report.skill_counts(_docs(spark, sf).select(skills.skills(F.col("text"), WORDS).alias("skills")))


@query("x21_skill_company_counts", f"""
SELECT skill, source AS normalized_company_name, count(*) AS jobs
FROM (SELECT source, unnest({_FOUND}) AS skill FROM documents) GROUP BY ALL""")
def _(spark, sf):
    return report.skill_company_counts(_docs(spark, sf).select(
        F.col("source").alias("normalized_company_name"), skills.skills(F.col("text"), WORDS).alias("skills")))
