"""Vector searches, page extraction, quotation linking, helpers and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import graph_search, quotations, shared, voronoi, wrappers

VECTOR = "vec_id long, embedding array<float>, label int"


def vectors(rows, spark):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTOR)


def cloud(n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, d))
    rows[: n // 3] = rows[0]  # a third of all rows is one vector
    return [(int(i), rows[i].astype(np.float32).tolist()) for i in range(n)]


ODD = [(None, [1.0] * 8), (100, None), (200, [math.nan] + [1.0] * 7), (300, [None] + [1.0] * 7), (400, [1.0]),
       (500, [math.inf] * 8), (600, [])]


def test_voronoi_join_is_exact(scratch):
    rows = cloud(900)
    got = voronoi.top_products(vectors(rows + ODD + rows[:3], scratch), pivots=9, block_rows=70, block_queries=4)
    whole = np.floor(256 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64)
    expected = []
    for q in range(0, 900, 50):
        scores = whole @ whole[q]
        order = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(order, 1)]
    assert sorted(map(tuple, got.collect())) == expected
    assert voronoi.top_products(vectors([], scratch)).count() == 0
    assert voronoi.top_products(vectors([(1, [1.0]), (2, [1.0])], scratch)).count() == 0
    assert [tuple(r) for r in voronoi.top_products(vectors([(0, [2.0]), (7, [-1.0])], scratch)).collect()] == [(0, 1, 7, -131072)]


def test_voronoi_sums_beyond_floats(scratch):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0])]
    got = voronoi.top_products(vectors(rows, scratch)).collect()
    a, b = 256 * 10_000_000, 256  # the sums still fit a long
    assert [(r.vec_id, r.score) for r in got] == [(2, a * a + 2 * b * b), (1, a * a + b * b)]


def test_graph_search_recall_and_scores(scratch):
    rows = cloud(3000, d=16)
    got = graph_search.nearest(vectors(rows + ODD + [(700, [0.0] * 16)], scratch), shard_rows=800).collect()
    points = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    points[700] = np.inf  # two vectors under one id: the smaller counts, see below
    hits = total = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    for q in range(0, 3000, 100):
        if q == 700:
            continue
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        best = sorted((d, i) for i, d in enumerate(far) if i != q and np.isfinite(d))[:10]
        mine = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - far[r.vec_id]) < 1e-12 for r in mine if np.isfinite(far[r.vec_id]))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        limit = best[-1][0]
        hits += sum(r.score <= limit + 1e-12 for r in mine)
        total += 10
    assert hits / total >= 0.95


def test_graph_search_of_few_rows(scratch):
    assert graph_search.nearest(vectors([], scratch)).count() == 0
    assert graph_search.nearest(vectors([(0, [1.0, 0.0])], scratch)).count() == 0
    got = graph_search.nearest(vectors([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [0.0, 0.0])], scratch))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()] == [(0, 1, 1, 0.0), (0, 2, 2, math.sqrt(2))]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<div class="cookie-notice">We use cookies</div><header><p>Site</p></header>
<nav><ul><li><a href="/a">Home</a><li><a>News {i}</a></ul></nav>
<article><header><h1>Title &amp; {i}</h1></header><p>First <b>bold
 text</b><br>after {i}<p class="ad">Buy {i}</p><p>Second&nbsp;one<script>var t="</p>";</script></p>
<!-- <p>gone</p> --><aside>Side {i}</aside><div class="comments"><p>Reader {i}</p></div></article>
<form><p>Search</p></form><footer>&copy; {i}</footer></body></html>"""


def test_article_pages(scratch):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i=i)) for i in range(6)]
    rows += [(6, None, None), (7, "http://h0.org/x", ""), (None, "nonsense", "<p>a<div>b"), (8, "u", "x" * 200_000), (8, "u", "x" * 200_000),
             (9, "http://h1.org/9", "<p <<a href='>'> & &lt; </b></i>")]
    frame = scratch.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = wrappers.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 6:
            assert r.text == f"Title & {r.page_id}\nFirst bold text after {r.page_id}\nSecond one"
        if r.page_id in (6, 7):
            assert r.text == ""
        if r.page_id == 8:
            assert r.text == "x" * 200_000
        if r.page_id is None:
            assert r.text == "a\nb"
    assert wrappers.extract(frame.limit(0)).count() == 0


def test_constant_slots_are_template(scratch):
    page = "<body><div id=top>Daily Paper</div><div id=story-{i}><p>Story {i}</p><p>More {i}</p></div><div id=end>Imprint</div></body>"
    rows = [(i, f"https://w.example/{i}", page.format(i=i)) for i in range(8)]
    got = wrappers.extract(scratch.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i}\nMore {i}" for i in range(8)}


def test_tree_match_keeps_order_and_parents():
    left, _ = wrappers.parse("<body><div class=a><p>x</p></div><ul><li>y</ul><div class=b>z</div></body>")
    right, _ = wrappers.parse("<body><div class=b>z</div><div class=a><p>x</p></div></body>")
    pairs = wrappers.tree_match(left, right)
    for a, b in pairs.items():
        assert left[a][1] == right[b][1]
        if a:
            assert pairs[left[a][0]] == right[b][0]
    assert len(pairs) == 5 - 1


def test_quotes_link_messages(scratch):
    rows = [
        (1, 0, "user", "How do I sort? I have a list. It is long."),
        (1, 1, "user", "What about the weather?"),
        (1, 2, "assistant", "On Monday, user wrote:\n> How do I sort? I have\n> a list.\n\nUse sorted()."),
        (1, 3, "assistant", "> What about the weather?\nSunny."),
        (1, 4, "user", "> > How do I sort?\nno\n>> nested only"),
        (1, 5, "user", "> USE   sorted().\n> > How do I sort?\nThanks."),
        (2, 0, "user", "> Sunny.\nOther conversation."), (None, 0, "user", "> Sunny.\nx"), (1, None, None, None), (3, 0, "user", ""),
        (3, 0, "user", ""),
    ]
    frame = scratch.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = quotations.conversations(frame.drop("position")).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: r.parent_turn for t, r in one.items()} == {None: None, 0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: 2}
    assert [r.turn for r in sorted(one.values(), key=lambda r: r.position)] == [None, 0, 2, 4, 5, 1, 3]
    assert one[2].own_text == "Use sorted()." and one[5].own_text == "Thanks." and one[4].own_text == "no"
    assert one[3].formatted == "<|assistant|>\nSunny.\n<|end|>\n" and one[5].quoted_levels == 2
    assert all(r.parent_turn is None for r in got if r.conv_id != 1)
    assert sorted(r.position for r in got if r.conv_id == 3) == [0, 1]
    assert quotations.conversations(frame.drop("position").limit(0)).count() == 0


def test_ranks_and_components(scratch):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else rng.choice([1, 1, 1, 2, 3]), rng.randrange(50)) for _ in range(2000)]
    ranked = shared.rank_in_group(scratch.createDataFrame(rows, "g int, x int"), ["g"], ["x"], "n").collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.g, []).append((r.n, r.x))
    assert sum(map(len, groups.values())) == 2000
    for pairs in groups.values():
        assert [n for n, _ in sorted(pairs)] == list(range(len(pairs)))
        assert [x for _, x in sorted(pairs)] == sorted(x for _, x in pairs)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 300), (300, 250), (7, 7)] + [(1000, 1000 + i) for i in range(1, 60)]
    found = {r.node: r.component for r in shared.components(scratch.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(91)}, 200: 200, 300: 200, 250: 200, **{1000 + i: 1000 for i in range(60)}}


def test_pipeline_stages(scratch):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = scratch.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = shared.written(stage(scratch, docs, sf), name)
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= before and docs.select("doc_id").distinct().count() == now
        before = now
    packed = cp.STAGES[-1][1](scratch, docs, sf)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


@pytest.mark.parametrize("name", ["op5_voronoi_topk", "op8_jaccard_join"])
def test_sql_says_the_same(scratch, name):
    from vacantia.llm.queries import ORACLES, QUERIES
    from workload.check import compare, duck

    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES[name](scratch, sf), duck(sf), ORACLES[name]) is None
