"""T, F3–F9: tokens, inverted index, full-text conditions by scan and by index."""

from pyspark.sql import functions as F

from vacantia import work_dir
from vacantia.functions.text import tokens
from vacantia.operators import keywords as kw
from vacantia.operators import text_index
from vacantia.operators.stored_index import StoredIndex
from workload.bindings import ctes, table, view, with_tokens
from workload.registry import query

_HAS = "job_id IN (SELECT job_id FROM tok WHERE token = '{0}')"
_PHRASE = """job_id IN (SELECT a.job_id FROM tok a JOIN tok b
  ON a.job_id = b.job_id AND a.field = b.field AND b.pos = a.pos + 1
  WHERE a.token = '{0}' AND b.token = '{1}')"""
_NEAR = """job_id IN (SELECT a.job_id FROM tok a JOIN tok b ON a.job_id = b.job_id AND a.field = b.field
  WHERE a.token = '{0}' AND b.token = '{1}' AND abs(a.pos - b.pos) <= {2} + 1)"""

_IN_SET = "job_id IN (SELECT job_id FROM tok WHERE token = '{0}' AND field IN ('title', 'company'))"

# Name → (condition, the same in SQL).
CONDITIONS = {
    "f3_all_words": (
        kw.from_text("Ering src1"), _HAS.format("ering") + " AND " + _HAS.format("src1")),
    "f3_accents_folded": (kw.from_text("MENTRE"), _HAS.format("mentre")),
    "f4_phrase": (kw.from_text('"of the"'), _PHRASE.format("of", "the")),
    "f4_punctuated_word": (kw.from_text("de.la"), _PHRASE.format("de", "la")),
    "f5_or": (kw.from_text("thing OR que"), _HAS.format("thing") + " OR " + _HAS.format("que")),
    "f6_not": (kw.from_text("the NOT thing"), _HAS.format("the") + " AND NOT " + _HAS.format("thing")),
    "f7_prefix": (kw.from_text("thi*"), "job_id IN (SELECT job_id FROM tok WHERE starts_with(token, 'thi'))"),
    "f8_field": (
        kw.from_text("title:the"),
        "job_id IN (SELECT job_id FROM tok WHERE token = 'the' AND field = 'title')"),
    "f9_near": (kw.from_text("NEAR(thing and, 3)"), _NEAR.format("thing", "and", 3)),
    "f9_near_default_gap": (kw.from_text("NEAR(que et)"), _NEAR.format("que", "et", 10)),
    "f5_brackets": (
        kw.from_text("(thing OR que) AND the"),
        f"({_HAS.format('thing')} OR {_HAS.format('que')}) AND {_HAS.format('the')}"),
    "f6_not_bracket": (
        kw.from_text("the NOT (thing OR and)"),
        f"{_HAS.format('the')} AND NOT ({_HAS.format('thing')} OR {_HAS.format('and')})"),
    "f8_field_set": (kw.from_text("{title company}:(the OR src1)"), f"({_IN_SET.format('the')} OR {_IN_SET.format('src1')})"),
    "f8_field_excluded": (
        kw.from_text("-raw_description:the"),
        "job_id IN (SELECT job_id FROM tok WHERE token = 'the' AND field <> 'raw_description')"),
    "f8_first_word": (
        kw.from_text("raw_description:^the"),
        "job_id IN (SELECT job_id FROM tok WHERE token = 'the' AND field = 'raw_description' AND pos = 0)"),
    "f9_near_phrases": (
        kw.from_text('NEAR("of the" and, 4)'),
        """job_id IN (SELECT a.job_id FROM tok a JOIN tok b ON a.job_id = b.job_id AND a.field = b.field AND b.pos = a.pos + 1
  JOIN tok c ON c.job_id = a.job_id AND c.field = a.field
  WHERE a.token = 'of' AND b.token = 'the' AND c.token = 'and'
    AND a.pos >= c.pos - 6 AND c.pos >= a.pos - 5)"""),
}


def _indexed_text(spark, sf):
    return view(spark, sf, "jobs").select(
        "job_id", "title", "company", "raw_description", "skills")


_STORED: dict[tuple[str, str], StoredIndex] = {}


def stored_index(spark, sf):
    """The index of the whole postings table, written once per application and table."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _STORED:
        _STORED[place] = StoredIndex.create(_indexed_text(spark, sf), work_dir(spark, "index"), 16, 4)
    return _STORED[place]


def _register(name, condition, where):
    sql = with_tokens() + f"\nSELECT job_id FROM jobs WHERE {where}"

    @query(f"{name}_scan", sql)
    def _(spark, sf):
        return kw.search_scan(_indexed_text(spark, sf), condition)

    @query(f"{name}_index", sql)
    def _(spark, sf):
        return stored_index(spark, sf).search(condition)


for _name, (_condition, _where) in CONDITIONS.items():
    _register(_name, _condition, _where)


@query("f8_field_roles", r"""
SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND list_contains(
  string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), 'the')""")
def _(spark, sf):
    rows = table(spark, sf, "conversations")
    hit = kw.word("assistant", "role") & kw.word("the", "text")
    return rows.filter(hit.scan(kw.field_texts(rows, ["role", "text"]))).select("conv_id", "turn")


@query("t1_tokens", r"""
SELECT token, count(*) AS occurrences FROM (SELECT unnest(list_filter(
  string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM documents)
GROUP BY token""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))


def _flat(index):
    return index.select("token", "field", "job_id",
                        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("t2_inverted_index", with_tokens() + """
SELECT token, field, job_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM tok GROUP BY token, field, job_id""")
def _(spark, sf):
    return _flat(text_index.build_index(_indexed_text(spark, sf)))


_REPLACED = with_tokens().replace(
    "text AS raw_description", "CASE WHEN doc_id % 5 = 0 THEN 'replaced text ' || doc_id ELSE text END AS raw_description")


def _replaced(jobs):
    return jobs.filter("CAST(job_id AS BIGINT) % 5 = 0").withColumn(
        "raw_description", F.concat(F.lit("replaced text "), F.col("job_id")))


@query("t2_stored_index", with_tokens() + """
SELECT token, field, job_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM tok GROUP BY token, field, job_id""")
def _(spark, sf):
    return _flat(stored_index(spark, sf).postings())


_ENTRIES = """
SELECT token, field, job_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM tok GROUP BY token, field, job_id"""


@query("t3_index_follows_updates", _REPLACED + _ENTRIES)
def _(spark, sf):
    jobs = _indexed_text(spark, sf)
    return _flat(text_index.refresh_index(text_index.build_index(jobs), _replaced(jobs)))


@query("t3_segments", _REPLACED + _ENTRIES.replace("FROM tok", "FROM tok WHERE CAST(job_id AS BIGINT) % 7 <> 0"))
def _(spark, sf):
    """One segment of updates and one of deletions beside the first one; read without compaction."""
    jobs = _indexed_text(spark, sf)
    index = StoredIndex.create(jobs, work_dir(spark, "index"), 16, 4)
    index = index.upsert(_replaced(jobs)).delete(jobs.filter("CAST(job_id AS BIGINT) % 7 = 0"))
    return _flat(index.postings())


@query("t3_segments_search", _REPLACED + "SELECT job_id FROM jobs WHERE CAST(job_id AS BIGINT) % 7 <> 0 AND "
       + _HAS.format("replaced") + " AND NOT " + _HAS.format("the"))
def _(spark, sf):
    """The same two changes, folded up to the update, then searched."""
    jobs = _indexed_text(spark, sf)
    index = StoredIndex.create(jobs, work_dir(spark, "index"), 16, 4)
    index = index.upsert(_replaced(jobs)).delete(jobs.filter("CAST(job_id AS BIGINT) % 7 = 0"))
    return index.compact(upto=index.manifest.segments[1]).search("replaced NOT the")
