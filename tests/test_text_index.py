"""The full-text grammar against a full-text engine, and the stored index with its segments."""

import contextlib
import io
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from vacantia.operators import keywords as kw
from vacantia.operators import stored_index, text_index
from vacantia.operators.stored_index import StoredIndex
from vacantia.plans.search import SearchFilters, matching
from vacantia.schema import APPLICATIONS, POSTINGS

FIELDS = ["title", "company", "body"]
WORDS = ["ab", "abc", "b", "c", "d", "Été", "ete"]

LINES = [
    "ab", "ab b", '"ab b"', "a*", '"b a" *', "b + c", "ab AND (c OR d)", "(ab OR c) AND b", "(ab OR c) NOT (b OR d)",
    "ab OR b AND c", "ab NOT b OR c", "ab NOT b c", "title : ab", "{title body} : c", "- title : ab", "-{title company}:b",
    "title:(ab OR c) AND body:b", "title:(body:ab)", "title:(ab OR company:c)", "^ab", "^ \"ab b\"", "body:^c", "^a*",
    "NEAR(ab c, 2)", 'NEAR("ab b" c, 2)', 'NEAR("ab b" "c d", 1)', 'NEAR(c "b ab", 0)', "NEAR(a* d, 1)", "NEAR(ab b c, 3)",
    'title:NEAR("b c" d, 4)', "NEAR(ab) AND c", "NEAR(b b, 1)", "ete", "{title}:(ab OR (b AND c)) NOT d", "((ab))",
    'NEAR("ab ab" ab, 1)', 'ab AND "c d" OR NEAR(b d, 0)', "NEAR c", "and or not",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(str(i), *[" ".join(rng.choices(WORDS, k=rng.randrange(n))) for n in (5, 4, 14)]) for i in range(250)]


@pytest.fixture(scope="module")
def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id string, title string, company string, body string").cache()


@pytest.fixture(scope="module")
def engine(rows):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(job_id UNINDEXED, title, company, body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine to compare with")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    return con


@pytest.fixture(scope="module")
def index(jobs, tmp_path_factory):
    return StoredIndex.create(jobs, str(tmp_path_factory.mktemp("index")), 8, 2, fields=FIELDS)


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("line", LINES)
def test_lines_mean_what_the_engine_means(engine, jobs, index, line):
    expected = sorted(r[0] for r in engine.execute("SELECT job_id FROM t WHERE t MATCH ?", [line]))
    condition = kw.from_text(line, FIELDS)
    assert ids(kw.search_scan(jobs, condition, fields=FIELDS)) == expected
    assert ids(index.search(line)) == expected


@pytest.mark.parametrize("line", [
    "(ab", "ab)", "-ab", "NOT ab", "ab OR", "AND ab", "ab AND AND b", "NEAR(ab", "NEAR(ab, x)", "NEAR(,2)", "{}:ab",
    "^", '"ab', "()", "*", "title:", "", '""', "ab NOT",
])
def test_unreadable_lines_raise(line):
    with pytest.raises(ValueError):
        kw.from_text(line)


def test_unknown_fields_raise(spark, jobs, index):
    for line in ("nope:ab", "{title nope}:ab", "-nope:ab", "nope:(ab OR b)"):
        with pytest.raises(ValueError, match="nope"):
            kw.from_text(line, FIELDS)
        with pytest.raises(ValueError, match="nope"):
            index.search(line)
        with pytest.raises(ValueError, match="nope"):
            kw.search_scan(jobs, kw.from_text(line), fields=FIELDS)
    applications = spark.createDataFrame([], APPLICATIONS)
    with pytest.raises(ValueError, match="nope"):
        matching(spark.createDataFrame([], POSTINGS), applications, SearchFilters(keywords="nope:x"), "2026-01-01 00:00:00")


def test_bare_not_and_empty_text(spark, jobs, index):
    have = {r.job_id for r in jobs.collect() if "ab" in (r.title + " " + r.company + " " + r.body).split()}
    assert ids(index.search(~kw.word("ab"))) == sorted({r.job_id for r in jobs.collect()} - have)
    empty = spark.createDataFrame([("x", None, "", " ")], jobs.schema)
    assert ids(index.upsert(empty).search(~kw.word("nothing"))) == sorted([*ids(jobs.select("job_id")), "x"])


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_search_opens_only_the_buckets_of_its_words(index):
    for line in ("abc", '"ab c"', "abc*", "NEAR(ab c)", "title:ab"):
        text = plan(index.search(line))
        line_of = next(l for l in text.splitlines() if "PartitionFilters" in l)
        assert "token_bucket" in line_of and "xxhash64" not in line_of
        assert "token" in next(l for l in text.splitlines() if "PushedFilters" in l)
    read = index.postings(kw.word("abc")).inputFiles()
    assert len({f.split("token_bucket=")[1].split("/")[0] for f in read}) <= 8
    assert "xxhash64" not in plan(index.postings(kw.from_text("ab OR d OR ete")))


def flat(postings):
    return sorted((r.token, r.field, r.job_id, tuple(r.positions)) for r in postings.collect())


def test_segments_follow_changes(spark, jobs, rows, tmp_path):
    path = str(tmp_path / "index")
    rng = random.Random(9)
    state = {r[0]: r for r in rows}
    index = StoredIndex.create(jobs, path, 4, 2, fields=FIELDS)
    for turn in range(6):
        if turn % 3 == 2:
            gone = rng.sample(sorted(state), 20)
            state = {k: v for k, v in state.items() if k not in gone}
            index = index.delete(spark.createDataFrame([(k,) for k in gone], "job_id string"))
        else:
            # Replaced, new and returning postings.
            fresh = [(str(k), f"turn{turn}", "ab", " ".join(rng.choices(WORDS, k=6))) for k in rng.sample(range(300), 40)]
            state.update({r[0]: r for r in fresh})
            index = index.upsert(spark.createDataFrame(fresh, jobs.schema))
        if turn == 3:
            before = index
            index = index.compact(upto=index.manifest.segments[2])
            assert len(index.manifest.segments) == 3
            assert flat(before.postings()) == flat(index.postings())
        now = spark.createDataFrame(list(state.values()), jobs.schema)
        assert flat(index.postings()) == flat(text_index.build_index(now, fields=FIELDS))
        for line in ("turn1 OR turn3", "ab NOT c", '"b c"'):
            assert ids(index.search(line)) == ids(kw.search_scan(now, kw.from_text(line), fields=FIELDS))
        assert ids(index.search(~kw.word("ab"))) == ids(kw.search_scan(now, ~kw.word("ab"), fields=FIELDS))
    assert StoredIndex.open(spark, path).manifest == index.manifest
    folded = index.compact()
    assert len(folded.manifest.segments) == 1 and flat(folded.postings()) == flat(index.postings())
    assert ids(folded.keys()) == sorted(state)


def test_an_update_leaves_earlier_segments_alone(spark, jobs, tmp_path):
    path = str(tmp_path / "index")
    index = StoredIndex.create(jobs, path, 4, 2, fields=FIELDS)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    after = index.upsert(jobs.limit(1).withColumn("body", F.lit("fresh words")))
    now = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    assert before.items() <= now.items()
    assert len(now) - len(before) <= 8
    assert after.search("fresh").count() == 1 and index.search("fresh").count() == 0
    # What a failed change left is not read, and the next change takes its place.
    jobs.write.mode("overwrite").parquet(f"{path}/postings/segment=2/token_bucket=0")
    jobs.write.mode("overwrite").parquet(f"{path}/keys/segment=2")
    assert after.search("fresh").count() == 1
    again = after.delete(jobs.filter("job_id = '3'").select("job_id"))
    assert again.manifest.segments == (0, 1, 2) and "3" not in ids(again.keys())


def test_tasks_get_slices_of_bounded_text(spark, jobs, tmp_path, monkeypatch):
    """A larger table means more tasks, not larger ones: entries are not gathered by bucket and part."""
    monkeypatch.setattr(stored_index, "SLICE", 1000)
    index = StoredIndex.create(jobs, str(tmp_path / "index"), 4, 2, fields=FIELDS)
    files = {}
    for f in (tmp_path / "index" / "postings").rglob("*.parquet"):
        files.setdefault(f.parent.name, []).append(f)
    assert max(map(len, files.values())) > 2
    for f in sum(files.values(), []):
        tokens = [r.token for r in spark.read.parquet(str(f)).select("token").collect()]
        assert tokens == sorted(tokens)
    assert flat(index.postings()) == flat(text_index.build_index(jobs, fields=FIELDS))
    assert flat(index.compact().postings()) == flat(index.postings())


def folding(index, monkeypatch, **kw):
    """The folded index, and what each shuffle of the folding moves."""
    plans, write = [], StoredIndex._write

    def spied(self, entries, *rest):
        write(self, entries, *rest)
        plans.append(plan(entries))

    with monkeypatch.context() as patch:
        patch.setattr(StoredIndex, "_write", spied)
        folded = index.compact(**kw)
    return folded, re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plans[-1]), plans[-1]


def test_folding_leaves_entries_in_their_slices(spark, jobs, rows, tmp_path, monkeypatch):
    """Only the entries of a smaller segment and keys are shuffled, whatever the size; no keys are broadcast."""
    monkeypatch.setattr(stored_index, "SLICE", 1000)
    index = StoredIndex.create(jobs, str(tmp_path / "index"), 4, 2, fields=FIELDS)
    slices = index.manifest.slices[0]
    few = jobs.filter("CAST(job_id AS INT) % 50 = 0").withColumn("body", F.lit("fresh words"))
    index = index.upsert(few).delete(jobs.filter("CAST(job_id AS INT) % 7 = 0").select("job_id"))
    assert slices > 2 * index.manifest.slices[1] > 0 == index.manifest.slices[2]

    once, moved, text = folding(index, monkeypatch, upto=index.manifest.segments[1])
    assert sum("positions" in m for m in moved) == 1 and "Broadcast" not in text and "Bucketed: true" in text
    assert flat(once.postings()) == flat(index.postings())
    assert once.manifest.slices == (slices, 0) and StoredIndex.open(spark, once.path).manifest == once.manifest
    folded, moved, text = folding(once, monkeypatch)
    assert moved and not any("positions" in m for m in moved[:1]) and "Broadcast" not in text
    assert flat(folded.postings()) == flat(index.postings()) and ids(folded.keys()) == ids(index.keys())
    assert ids(folded.search("fresh")) == sorted(r.job_id for r in few.collect() if int(r.job_id) % 7)
    for f in (tmp_path / "index" / "postings" / f"segment={once.manifest.segments[0]}").rglob("*.parquet"):
        keys = spark.read.parquet(str(f)).select(stored_index.key_slice("job_id", slices)).distinct().collect()
        assert len(keys) == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vacantia_index")]


def test_slices_grow_with_the_postings(jobs, tmp_path, monkeypatch):
    index = StoredIndex.create(jobs.limit(0), str(tmp_path / "index"), 4, 2, fields=FIELDS).upsert(jobs)
    assert index.manifest.slices == (1, 1)
    monkeypatch.setattr(stored_index, "SLICE", 500)
    grown = index.compact()
    assert grown.manifest.slices[0] > 8
    assert flat(grown.postings()) == flat(index.postings())
    assert grown.upsert(jobs.limit(3)).compact().manifest.slices == grown.manifest.slices


def test_folding_with_null_and_repeated_keys(spark, jobs, tmp_path):
    odd = spark.createDataFrame(
        [(None, "ab", "", "c"), (None, "b", "", ""), ("1", "ab", "", "c"), ("1", "d", "", "c"), ("2", None, None, None), ("3", "c", "", "")],
        jobs.schema)
    index = StoredIndex.create(odd, str(tmp_path / "it's 1 index"), 4, 2, fields=FIELDS)
    for later in (index, index.upsert(odd.filter("job_id IS NULL OR job_id = '3'")), index.delete(odd.select("job_id"))):
        folded = later.compact()
        assert sorted(map(str, folded.postings().collect())) == sorted(map(str, later.postings().collect()))
        assert sorted(map(str, folded.keys().collect())) == sorted(map(str, later.keys().collect()))


def test_an_index_stored_without_slices(spark, jobs, tmp_path):
    """As written by earlier versions: files that are not bucketed, no bytes beside the keys."""
    path = str(tmp_path / "index")
    entries = text_index.build_index(jobs, fields=FIELDS).withColumn("token_bucket", stored_index.token_bucket(F.col("token"), 4))
    entries.repartition(3).write.partitionBy("token_bucket").parquet(f"{path}/postings/segment=0")
    jobs.select("job_id", F.lit(True).alias("live")).write.parquet(f"{path}/keys/segment=0")
    body = '{"segments": [0], "buckets": 4, "files_per_bucket": 2, "key": "job_id", "fields": ["title", "company", "body"]}'
    spark.createDataFrame([(1, body)], "version long, body string").coalesce(1).write.json(f"{path}/manifest")
    index = StoredIndex.open(spark, path).upsert(jobs.limit(5).withColumn("body", F.lit("fresh")))
    assert index.manifest.slices == (0, 1) and index.search("fresh").count() == 5
    folded = index.compact()
    assert flat(folded.postings()) == flat(index.postings())
    assert ids(folded.keys()) == ids(jobs.select("job_id"))


@pytest.mark.parametrize("at_once", [1, 7, 1_000_000])
def test_entries_of_odd_rows(spark, at_once, monkeypatch):
    monkeypatch.setattr(text_index, "TOKENS_AT_ONCE", at_once)
    texts = [None, "", " ", "..,", "b a b", " b", "b ", "--b--É e\u0301 b", "日本 b 日本", "a\nb\ta", "x" * 5000, "b" + " a b" * 300]
    keys = [1, 1, None, 2, 3, 3, None, 4, 5, 6, 7, 8]
    rows = [(k, t, [t, None, "b c"] if i % 2 else None) for i, (k, t) in enumerate(zip(keys, texts))]
    jobs = spark.createDataFrame(rows, "job_id long, body string, tags array<string>").coalesce(2)
    index = text_index.build_index(jobs, fields=["body", "tags"])
    assert dict(index.dtypes) == {"token": "string", "field": "string", "job_id": "bigint", "positions": "array<int>"}
    expected = []
    for k, body, tags in rows:
        for field, text in (("body", body), ("tags", None if tags is None else " ".join(x for x in tags if x is not None))):
            words = re.findall(r"[^\W_]+", (text or "").lower().replace("e\u0301", "e").replace("é", "e"))
            expected += [(w, field, k, tuple(i for i, x in enumerate(words) if x == w)) for w in set(words)]
    found = [(r.token, r.field, r.job_id, tuple(r.positions)) for r in index.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_an_empty_table(spark, jobs, tmp_path):
    index = StoredIndex.create(jobs.limit(0), str(tmp_path / "index"), 4, 2, fields=FIELDS)
    assert index.search("ab").count() == 0 and index.keys().count() == 0
    assert ids(index.upsert(jobs.filter("job_id = '7'")).keys()) == ["7"]
