"""Wrapper induction: the template decides, with brute force for the tree match and hostile trees."""

import itertools
import random
import time

import pytest

from vacantia.llm import wrappers

PAGES = "page_id long, url string, html string"


def story(i, n=40):
    rng = random.Random(i)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def texts(scratch, pages):
    rows = [(i, f"https://w.example/{i}", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in wrappers.extract(scratch.createDataFrame(rows, PAGES)).collect()}


def test_meaningless_class_names_and_no_article(scratch):
    """Constant slots go, the heaviest varying region stays, a short varying slot elsewhere goes."""
    page = ("<body><div class=q1>Daily Paper</div><div class=q2><h1>Title {i}</h1><p>{a}</p><p>{b}</p></div>"
            "<div class=q3>Buy {c}</div><div class=q4>Imprint</div></body>")
    pages = [page.format(i=i, a=story(i), b=story(i + 100), c=story(i + 200, 3)) for i in range(8)]
    assert texts(scratch, pages) == {i: f"Title {i}\n{story(i)}\n{story(i + 100)}" for i in range(8)}


def test_constant_slots_inside_article_go(scratch):
    page = ("<body><article><div class=q1>Follow us on the usual channels</div><h1>Title {i}</h1><p>{a}</p>"
            "<section>Read our rules before you write</section></article></body>")
    pages = [page.format(i=i, a=story(i)) for i in range(6)]
    assert texts(scratch, pages) == {i: f"Title {i}\n{story(i)}" for i in range(6)}


def test_copies_are_no_evidence_of_template(scratch):
    """Sixty copies and near copies of one article keep its heading, beside two other pages of the host."""
    page = "<body><article><h1>{t}</h1><p>{a}</p></article></body>"
    words = story(1, 300).split()
    pages = []
    for i in range(60):
        mine = list(words)
        if i % 2:
            mine[(37 * i) % 300] = f"edit{i}"
        pages.append((f"Storm hits coast", " ".join(mine)))
    pages += [("Other", story(2)), ("Third", story(3))]
    got = texts(scratch, [page.format(t=t, a=a) for t, a in pages])
    assert got == {i: f"{t}\n{a}" for i, (t, a) in enumerate(pages)}


def test_small_hosts_keep_what_is_not_known_to_be_constant(scratch):
    page = "<body><nav>Home</nav><article><h1>Same</h1><p>{a}</p></article></body>"
    got = texts(scratch, [page.format(a=story(i)) for i in range(2)])
    assert got == {i: f"Same\n{story(i)}" for i in range(2)}


def test_the_template_changes_the_answer():
    skeleton, _ = wrappers.parse("<body><article><div class=a>x</div><p>y</p></article></body>")
    free = wrappers.content_nodes(skeleton, set())
    assert set(free) - set(wrappers.content_nodes(skeleton, {free[1]})) == {free[1]}


def tree(rng, size):
    nodes = [(-1, "html", "")]
    for _ in range(size):
        nodes.append((rng.randrange(len(nodes)), rng.choice(["div", "p"]), rng.choice(["", "a", "b"])))
    return nodes


def brute(left, right, a=0, b=0):
    """Best weight of a matching of two subtrees, over all order-preserving pairings of their children."""
    xs = [i for i, n in enumerate(left) if n[0] == a]
    ys = [i for i, n in enumerate(right) if n[0] == b]
    best = 0
    for size in range(min(len(xs), len(ys)) + 1):
        for some in itertools.combinations(xs, size):
            for other in itertools.combinations(ys, size):
                if all(left[x][1] == right[y][1] for x, y in zip(some, other)):
                    best = max(best, sum(brute(left, right, x, y) for x, y in zip(some, other)))
    return best + 1 + (left[a][2] == right[b][2])


@pytest.mark.parametrize("seed", range(60))
def test_tree_match_is_a_heaviest_one(seed):
    rng = random.Random(seed)
    left, right = tree(rng, 7), tree(rng, 7)
    if seed % 3 == 0:
        right = left[:]
        right[3] = (right[3][0], "p", "c")
    pairs = wrappers.tree_match(left, right)
    got = 0
    for a, b in pairs.items():
        assert left[a][1] == right[b][1]
        assert not a or pairs[left[a][0]] == right[b][0]
        got += 1 + (left[a][2] == right[b][2])
    for (a, b), (c, d) in itertools.combinations(pairs.items(), 2):
        if left[a][0] == left[c][0]:
            assert (a < c) == (b < d)
    assert got == brute(left, right)


def test_deep_unclosed_and_wide_pages_take_linear_time():
    began = time.time()
    deep, _ = wrappers.parse("<div>" * 30_000 + "x" + "</p>" * 30_000)
    other, _ = wrappers.parse("<div>" * 29_000 + "<p>y")
    assert len(wrappers.tree_match(deep, other)) == 29_001
    names = wrappers.slots(deep, other)
    assert max(map(len, names)) < 40 and len(set(names)) == len(names)
    wide, _ = wrappers.parse("".join(f"<div class=a{'b' * (i % 997)}c{'d' * (i // 997)}>x</div>" for i in range(5_000)))
    assert len(wrappers.tree_match(wide, wide[:-3])) == len(wide) - 3
    assert len(wrappers.content_nodes(deep, set(), [1] * len(deep))) > 0
    assert time.time() - began < 20
