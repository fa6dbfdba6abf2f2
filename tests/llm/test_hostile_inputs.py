"""Texts and values meant to end or stall a job, and names that clash."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import alignment, graph_search, pseudonyms, quality, quotations, shared, voronoi

KEY = "k"


def hidden(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in pseudonyms.pseudonymize(df, KEY).orderBy("doc_id").collect()]


MILLION = 1_000_000


@pytest.mark.parametrize("text", [
    "x@" + "a." * MILLION + "com", "x@" + "a." * MILLION, "a" * MILLION + "@b.com", "@" * MILLION, "1." * MILLION, "1-" * MILLION,
    "+1 " * MILLION, "(1) " * MILLION, "AB12" * MILLION, "1234 " * MILLION, "0" * MILLION, "./-" * MILLION, "a@b." * MILLION,
], ids=["labels", "open", "local", "at", "dots", "dashes", "plus", "brackets", "iban", "groups", "zeros", "marks", "many"])
def test_pseudonyms_of_a_million_marks(scratch, text):
    assert len(hidden(scratch, [text])) == 1


def test_long_addresses_are_no_addresses(scratch):
    text = "a" * 400 + "@b.com"
    assert hidden(scratch, [text, "joe.doe@mail.example.com!"])[0] == text


def test_quote_marks_without_end(scratch):
    rows = [(1, 0, "user", "Hello there, friend."), (1, 1, "user", "> " * MILLION + "Hello there, friend.\nYes."),
            (1, 2, "user", ">" * MILLION), (1, 3, "user", " " * MILLION + "x" + " " * MILLION + "y"), (1, 4, "user", "\n" * 200_000),
            (1, 5, "user", "> q\n" * 100_000)]
    df = scratch.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotations.conversations(df).collect()}
    assert got[1]["quoted_levels"] == MILLION and got[1]["own_text"] == "Yes." and got[1]["parent_turn"] == 0
    assert got[2]["own_text"] == "" and got[3]["own_text"].startswith("x") and got[5]["quoted_levels"] == 1


def test_blank_and_short_lines_without_end(scratch):
    words = " ".join(f"w{i}" for i in range(60))
    texts = ["\n" * MILLION + words, "\n" * 10 + words + "\ntail", "a\n" * 200_000, "b\n" * 200_000, ("c\n" + "\n" * 50) * 5_000]
    df = scratch.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.dedup_lines(df).collect()}
    assert words in got[0]["text"] and words not in got[1]["text"] and got[1]["text"].endswith("tail")
    assert got[2]["text"] == texts[2]
    assert len(alignment.line_runs([1] * 50_000, [0] * 49_999 + [60], 50)) == 1


# ---- dates and telephone numbers -----------------------------------------------------------------

def test_date_pseudonyms_are_one_to_one_and_keep_their_form(scratch):
    forms = set()
    for n in range(0, 3653):
        day = dt.date(2000, 1, 1) + dt.timedelta(n)
        d, m, y = day.day, day.month, day.year
        forms |= {f"{d:02}/{m:02}/{y}", f"{m:02}/{d:02}/{y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}.{m:02}.{y}", f"{y}-{m:02}-{d:02}"}
    forms = sorted(forms)
    found = hidden(scratch, forms)
    assert len(set(found)) == len(forms)
    shape = lambda t: re.sub("[0-9]", "0", t)
    assert [shape(t) for t in found] == [shape(t) for t in forms]
    assert sum(a == b for a, b in zip(forms, found)) < len(forms) / 100
    for text in found:
        a, b, c = map(int, re.split("[/.-]", text))
        y, rest = (a, [(b, c)]) if a > 31 else (c, [(b, a), (a, b)])
        assert any(1 <= m <= 12 and _valid(y, m, d) for m, d in rest), text
    assert hidden(scratch, ["31/31/2020", "30/02/2020", "12/12/1800", "00/01/2020"]) == ["31/31/2020", "30/02/2020", "12/12/1800", "00/01/2020"]


def _valid(y, m, d):
    try:
        return bool(dt.date(y, m, d))
    except ValueError:
        return False


def test_one_number_in_two_forms_has_one_pseudonym(scratch):
    got = hidden(scratch, ["+15551234567", "+1 555 123 4567", "+1 (555) 123 4567", "+1-555-123-4567"])
    assert len({re.sub("[^0-9]", "", t) for t in got}) == 1
    assert got[0] != "+15551234567" and got[1].startswith("+1 ") and len(got[1]) == 15


# ---- classifier ---------------------------------------------------------------------------------------

def test_all_capitals_count(scratch):
    features = quality.Featurizer()
    assert quality._capitals("A" * 799) == 799 and quality._capitals("É" * 801 + "x") == 801
    marks = [features("ABCD " * n) for n in (100, 160, 200, 2000)]
    tenths = [10 * quality._capitals("ABCD " * n) // (5 * n) for n in (100, 160, 200, 2000)]
    assert tenths == [8] * 4 and len(marks) == 4


def test_ids_beside_null_stay_exact(scratch):
    rows = [(2**53 + 1, "some text", None), (None, "more text", 2**60 + 1), (None, None, None)]
    df = scratch.createDataFrame(rows, "doc_id long, text string, scored long").coalesce(1)
    got = quality.score(df, quality.OrdinalModel(np.zeros(1 << 4, dtype=np.float32), np.array([0.0, 1.0]), 4)).collect()
    assert {(r["doc_id"], r["scored"]) for r in got} == {(2**53 + 1, None), (None, 2**60 + 1), (None, None)}


def test_the_sample_is_bounded_by_rows(scratch, monkeypatch):
    df = scratch.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    seen = []
    monkeypatch.setattr(quality, "fit_arrays", lambda rows, *a, **k: seen.append(len(rows)))
    quality.fit(df, scratch.createDataFrame([(7, 1)], "doc_id long, grade int"), sample_rows=2)
    assert seen == [1]


# ---- vectors ------------------------------------------------------------------------------------------

KIND = "vec_id long, embedding array<double>"


def test_products_beyond_a_long(scratch):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e306, 1.0]), (4, [0.0, 0.5]), (5, [0.25, 0.25])]
    got = [tuple(r) for r in voronoi.top_products(scratch.createDataFrame(rows, KIND)).orderBy("rank").collect()]
    top, small = 2**63 - 1, 256 * 64
    assert got[:2] == [(0, 1, 1, top), (0, 2, 3, top)] and got[2][2:] == (5, top)
    assert got[3:] == [(0, 4, 4, 256 * 128), (0, 5, 2, -top)] and small


def test_every_length_is_searched_by_itself(scratch):
    rows = [(0, [1.0]), (50, [1.0, 0.0]), (1, [2.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0, 1.0]), (100, [1.0, 0.0, 0.0])]
    df = scratch.createDataFrame(rows, KIND)
    assert sorted((r["query_id"], r["vec_id"]) for r in voronoi.top_products(df).collect()) == [(0, 1), (50, 2), (100, 3)]
    assert sorted((r["query_id"], r["vec_id"]) for r in graph_search.nearest(df).collect()) == [(0, 1), (100, 3)]


def test_queries_are_sent_only_where_they_can_win(scratch, monkeypatch):
    """Ten far-apart groups: no query leaves the cells of its own."""
    rng = np.random.default_rng(2)
    centres = 8 * np.eye(16)[:10]
    rows = centres[rng.integers(0, 10, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    df = scratch.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], KIND)
    frames, real = [], voronoi.map_served
    monkeypatch.setattr(voronoi, "map_served", lambda d, *a: frames.append(d) or real(d, *a))
    got = sorted(map(tuple, voronoi.top_products(df, pivots=40, block_rows=200).collect()))
    whole = np.floor(256 * rows).astype(np.int64)
    expected = []
    for q in range(0, 4000, 50):
        scores = whole @ whole[q]
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5], 1)]
    assert got == sorted(expected)
    hosts = [f.filter("NOT is_query").count() for f in frames]
    guests = [f.filter("is_query").count() for f in frames]
    assert hosts == [4000, 4000]
    assert sum(guests) < 80 * 40 / 2  # queries x cells, were nothing ruled out


def test_graph_search_over_shards_and_slices(scratch):
    """Recall on the shared vectors, with several shards and queries in several Arrow batches."""
    df = scratch.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    before = scratch.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    scratch.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = graph_search.nearest(df, every=10, shard_rows=700).collect()
    finally:
        scratch.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in df.collect()}
    ids = np.array(sorted(rows))
    points = np.array([rows[i] for i in ids])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in [i for i in ids if i % 10 == 0]:
        far = np.sqrt(((points - rows[q]) ** 2).sum(axis=1))
        best = [i for _, i in sorted((d, i) for d, i in zip(far, ids) if i != q)[:10]]
        hits += len(found[q] & set(best))
    assert hits / (10 * sum(i % 10 == 0 for i in ids)) >= 0.9


# ---- names ---------------------------------------------------------------------------------------------

def test_clashing_names(scratch):
    names = ["found", "new", "row", "lost", "lines", "outer", "quoted", "position", "formatted", "own_text", "__task", "__place", "__first"]
    extra = ", ".join(f"`{n}` string" for n in names)
    docs = scratch.createDataFrame(
        [(1, "call +1 555 123 4567", *names), (2, None, *names)], f"doc_id long, text string, {extra}")
    for result in (pseudonyms.pseudonymize(docs, KEY), alignment.dedup_lines(docs)):
        for r in result.collect():
            assert [r[n] for n in names] == names
    chats = scratch.createDataFrame([(1, 0, "user", "Hi.", *names)], f"conv_id long, turn long, role string, text string, {extra}")
    r = quotations.conversations(chats).first()
    assert r["position"] == 0 and r["own_text"] == "Hi." and r["found"] == "found" and r["__task"] == "__task"
    ranked = shared.rank_in_group(chats, ["conv_id"], ["turn"], "position").first()
    assert ranked["position"] == 0 and ranked["__first"] == "__first"


def test_half_empty_tables(scratch):
    docs = scratch.createDataFrame([], "doc_id long, text string")
    assert pseudonyms.pseudonymize(docs, KEY).count() == alignment.dedup_lines(docs).count() == 0
    assert math.isclose(quality.score(docs, quality.OrdinalModel(np.zeros(16, dtype=np.float32), np.array([0.0]), 4), good=1).count(), 0)


def test_a_key_gives_the_same_pseudonyms_every_time(scratch):
    """Also where other columns were made in between."""
    texts = ["joe.doe@mail.example.com 12/11/2020 1/2/2020 192.168.7.9 4111 1111 1111 1111 +49 30 1234567 2020-05-06"]
    first = hidden(scratch, texts)
    F.transform(F.array(F.lit(1)), lambda x: x + 1)
    assert hidden(scratch, texts) == first and first != texts
