"""The pipeline over tables that hold NULLs, empty and long texts, repeats, clashing names, or nothing."""

import pytest

import corpus_pipeline

NAMES = ["expected_grade", "p_good", "n_deleted", "class_id", "n_links", "copy_id", "n_pseudonyms", "found", "lost", "row", "position"]


def prose(seed, n=120):
    return " ".join(f"word{(seed * 7919 + i * i * 31) % 997}" for i in range(n))


def run_on(scratch, tmp_path, docs, labels):
    extra = "".join(f", {n} string" for n in NAMES)
    kind = f"doc_id long, text string, lang string, source string, n_chars long{extra}"
    folder = str(tmp_path / "sf")
    scratch.createDataFrame([(*d, *NAMES) for d in docs], kind).repartition(2).write.parquet(f"{folder}/documents.parquet")
    scratch.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture()
def odd(scratch, tmp_path):
    docs = [(i, prose(i % 20) + ("" if i < 20 else " tail"), "en", "s", None) for i in range(40)]
    docs += [(100, None, None, None, None), (101, "", "en", "s", 0), (None, prose(77), None, "s", 5), (102, "x" * 300_000, "de", None, 1),
             (2**53 + 1, prose(88), "en", "s", 1), (103, prose(1), "en", "s", 1), (103, prose(1), "en", "s", 1), (104, "\n" * 5000 + prose(3), "en", "s", 1)]
    labels = [(i, 1, 0) for i in range(10)] + [(None, 1, None), (100, None, None), (101, 0, 1), (102, 0, 0), (3, 1, 0), (999, 1, 1)]
    return run_on(scratch, tmp_path, docs, labels)


def test_every_stage_takes_odd_rows(scratch, odd):
    docs = scratch.read.parquet(f"{odd}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(scratch, docs, odd)
        docs = scratch.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0 <= docs.count() <= before
        assert all(r["found"] == "found" and r["lost"] == "lost" and r["row"] == "row" for r in docs.collect()), name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](scratch, docs, odd).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_tables(scratch, tmp_path):
    folder = run_on(scratch, tmp_path, [], [])
    assert corpus_pipeline.run(scratch, folder).count() == 0
