"""License scans, filtered clustering and conversation repair, each against a brute-force version."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from vacantia.llm import clustering, licenses, repair

# ---- licenses ---------------------------------------------------------------------------------------

BASE = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}


def base_places(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for label, phrase in BASE.items() for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


MIT = licenses.NOTICES[7].text

TEXTS = [
    None, "", "   ", "cc", "cc by", "CC-BY-NC 4.0 cc by nc cc by\nnc", "Under the MIT License. under the mit licensed",
    "apache license, version 2.0; Apache License Version 2", "Éunder the mit license", "under the mit licenseé",
    "the mit license " * 40, "under the mit license " * 3000, "cc by " * 5 + "nc", "\x00cc\x7fby`nc{", "ÀÉ 中文 cc by nc",
    MIT, "intro words here " + MIT.upper() + " tail", MIT.replace("free of charge", "free of any charge whatsoever"),
    " ".join(MIT.split()[:30]), "x " * 5000 + MIT, "GNU General Public License, version 3", "gnu general public license version 2",
]


def scanned(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words long, spans string")
    return licenses.summary(df)


def test_license_base_places(scratch):
    rows = list(enumerate(TEXTS)) + [(None, "cc by nc"), (None, None), (3, "cc by nc"), (5, TEXTS[5]), (5, TEXTS[5])]
    got = [tuple(r)[:6] for r in scanned(scratch, rows).collect()]
    expected = [(i, *base_places(t)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_license_notices(scratch):
    got = {r["doc_id"]: r for r in scanned(scratch, list(enumerate(TEXTS))).collect()}
    by_text = {t: got[i] for i, t in enumerate(TEXTS)}
    assert by_text[MIT]["labels"] == "mit" and by_text[MIT]["score"] == 1.0
    assert got[16]["labels"] == got[17]["labels"] == got[19]["labels"] == "mit"
    assert 0.8 <= got[17]["score"] <= 1 and 0 < got[18]["score"] < 0.8 and got[18]["labels"] == ""
    assert (got[20]["labels"], got[21]["labels"]) == ("gpl-3", "gpl-2")
    assert got[0]["score"] == 0.0 and got[11]["n_base"] == 3000
    assert scanned(scratch, []).count() == 0


def test_license_spans_merge_neighbouring_diagonals(scratch):
    text = "one two " + MIT.replace("free of charge", "free of any charge at all") + " end"
    df = scratch.createDataFrame([(1, text)], "doc_id long, text string")
    spans = licenses.scan(df).first()["spans"]
    assert [(s["first"], licenses.NOTICES[s["template"] - 3].label) for s in spans] == [(2, "mit")]
    assert spans[0]["last"] == len(re.findall(r"[a-z]+", text.lower())) - 2


# ---- clustering -------------------------------------------------------------------------------------


def lloyd(rows, clusters, rounds, scale=1024):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    return centroids, sorted(((i, nearest(v)[1], min(nearest(v)[0], 2**63 - 1)) for i, v in kept), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")


def cloud(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    rows = 0.3 * (centres[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, 64)))
    rows[: n // 3] = rows[0]
    return [(i, rows[i].tolist()) for i in range(n)]


ODD = [(900, None), (901, [0.0] * 63), (902, [0.0] * 63 + [None]), (903, [math.nan] * 64), (904, [math.inf] + [0.0] * 63)]


@pytest.mark.parametrize("rows", [
    cloud(300) + ODD + cloud(20), [(None, [0.5] * 64), (2**53 + 1, [0.25] * 64), (None, [-0.1] * 64)], ODD,
    [], [(7, [0.1] * 64)] * 30, cloud(40) + [(5000, [1e30] * 64), (5001, [-1e306] * 64), (5002, [2e5] * 64)],
], ids=["cloud", "nulls", "odd", "empty", "equal", "large"])
def test_clustering_is_exact(scratch, rows):
    centroids, expected = lloyd(rows, 8, 4)
    found = clustering.cluster(vectors(scratch, rows).repartition(3), rounds=4)
    assert found.centroids == centroids
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.assigned.collect()), key=repr)
    assert got == expected
    final = clustering.with_inertia(found).collect()
    assert len(final) == len(expected)
    for r in final:
        assert r["centroid_sha256"] == clustering.digest(centroids[r["cluster"]])
        assert r["inertia"] == min(sum(d for _, _, d in expected), 2**63 - 1)


def test_clustering_rules_out_most_centroids(scratch):
    found = clustering.cluster(vectors(scratch, cloud(600)), rounds=3)
    assert sum(r["verified"] for r in found.assigned.collect()) < 600 * 8 / 2


# ---- conversation repair ----------------------------------------------------------------------------


def faults(rows):
    """Rows of one conversation in order -> codes of (initial, fault)."""
    seen, codes = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "k"
        seen.add((role, text))
        codes.append((role[:1], fault))
    return codes


def cheapest(codes):
    """(cost, audit, roles) over all edits, ASCII-least, by a table of whole sequences."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                new = (cost + 2, audit + "I", out + (("I", follow[state]),))
                if follow[state] not in best or new[:2] < best[follow[state]][:2]:
                    best[follow[state]] = new
        return best

    best = {"": (0, "", ())}
    for n, (role, fault) in enumerate(codes):
        # Sequences that end in an insert are kept apart: they compete at the next row.
        new = {}

        def offer(state, item):
            if state not in new or item[:2] < new[state][:2]:
                new[state] = item

        for start, (c0, a0, o0) in best.items():
            for state, (cost, audit, out) in inserted({start: (c0, a0, o0)}).items():
                offer(state, (cost + 3, audit + "D", out))
                if fault in "tk":
                    paid = cost + (fault == "t")
                    to = follow[state]
                    offer(to, (paid + 2, audit + "R", out + ((n, to),)))
                    if role == to:
                        offer(to, (paid, audit + "K", out + ((n, None),)))
                    if role == "s" and state == "":
                        offer("s", (paid, audit + "K", out + ((n, None),)))
        best = new
    ends = []
    for start, item in best.items():
        ends += [v for s, v in inserted({start: item}).items() if s in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def expected_repair(rows):
    """Rows of one conversation (turn, role, text) after damage, in order."""
    pairs = [(" " if r is None else r, " " if t is None else t) for _, r, t in rows]
    codes = faults(pairs)
    cost, audit, out = cheapest(codes)
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names[role]}:" if n == "I" else f"{names.get(role, pairs[n][0])}:{pairs[n][1]}" for n, role in out]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [c[0] for c in codes]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == x for _, f in codes) for x in "bdt"],
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def ordered(rows):
    def digest(role, text):
        role, text = " " if role is None else role, " " if text is None else text
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


def repaired(spark, rows, ids=None):
    kind = "conv_id long, turn long, role string, text string, pos string"
    df = spark.createDataFrame([(*r, "x") for r in rows], kind).repartition(3)
    names = None if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long")
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, names).collect()}


def random_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["Hi.", "What now?", "No stop", " ", None, "\t\n", "End!", "cut off…", "A.  "]
    return [(conv, rng.choice([None, i, i, i]), rng.choice(roles), rng.choice([rng.choice(texts), f"say {rng.randrange(99)}."]))
            for i in range(n)]


def test_repair_of_rows_against_all_edits(scratch):
    rng = random.Random(5)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randrange(1, 14))]
    rows += [(None, 0, "user", "Null id."), (2**53 + 1, 5, "assistant", "x"), (2**53 + 1, -(2**63), "user", "Y."), (2**53 + 1, 2**63 - 1, "a", "Z")]
    got = repaired(scratch, rows, ids=[*range(61), None, 2**53 + 1])
    for conv in {r[0] for r in rows} - {2**53 + 1}:
        assert got[conv] == expected_repair(ordered([r[1:] for r in rows if r[0] == conv])), conv
    assert got[2**53 + 1][0] == 2**63 - 1
    assert got[60] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(scratch, []) == {}


def test_crossings_of_small_cases_match_every_path():
    known = repair.tables()
    codes = [c for c in known if c != repair.END]
    rng = random.Random(2)
    for _ in range(400):
        run = [rng.choice(codes) for _ in range(rng.randrange(0, 7))] + [repair.END]
        states = repair.crossings([known[c][0] for c in run], 0, 0)
        audit = "".join(known[c][1][a, b] for c, a, b in zip(run, states, states[1:]))
        assert audit == cheapest([(c[0], c[1]) for c in run[:-1]])[1]


@pytest.mark.parametrize("short", [2, 5, 48])
def test_halving_gives_what_pointers_give(monkeypatch, short):
    known, rng = repair.tables(), random.Random(short)
    codes = [c for c in known if c != repair.END]
    run = [known[rng.choice(codes)][0] for _ in range(700)] + [known[repair.END][0]]
    monkeypatch.setattr(repair, "_SHORT", 10_000)
    whole = repair.crossings(run, 0, 0)
    monkeypatch.setattr(repair, "_SHORT", short)
    assert repair.crossings(run, 0, 0) == whole


def test_long_conversations_are_spread_over_blocks(scratch, monkeypatch):
    """One conversation with most rows; blocks of 8 rows, groups of 3 blocks: several levels."""
    monkeypatch.setattr(repair, "BLOCK", 8)
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"line {i}.", f"cut {i}", "", "same."])) for i in range(397)]
    rows += [(2, i, "user", f"{i}.") for i in range(15)] + [(3, i, "user", f"{i}.") for i in range(16)] + [(4, 0, "assistant", "x.")]
    got = repaired(scratch, rows)
    for conv in (1, 2, 3, 4):
        assert got[conv] == expected_repair([r[1:] for r in rows if r[0] == conv]), conv


def test_damage_of_the_contract(scratch):
    rows = [(c, t, "assistant", f"Text {t}. ok?") for c in range(30) for t in range(9)] + [(None, None, None, None), (1, None, None, "q.")]
    df = scratch.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in repair.damaged(df).collect()), key=repr)
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            expected += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert got == sorted(expected, key=repr)


def test_moves_cover_every_small_sequence():
    """The costs of single rows against all edit strings of up to three letters."""
    for code, (moves, edits) in repair.tables().items():
        for s, e, cost, _ in moves:
            best = None
            for n in range(4 if code == repair.END else 3):
                for run in itertools.product("I", repeat=n):
                    for last in ([""] if code == repair.END else "DKR"):
                        state, paid = s, 2 * n
                        for _ in run:
                            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                        if code == repair.END:
                            ok, to = state in (0, 3), 0
                        elif last == "D":
                            ok, to, paid = True, state, paid + 3
                        else:
                            to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                            paid += (code[1] == "t") + 2 * (last == "R")
                            ok = code[1] in "tk"
                            if last == "K":
                                if code[0] == "s" and state == 0:
                                    to = 1
                                else:
                                    ok = ok and code[0] == {2: "u", 3: "a"}[to]
                        if ok and to == e and (best is None or (paid, "I" * n + last) < best):
                            best = (paid, "I" * n + last)
            assert best == (cost, edits[s, e]), (code, s, e)
