"""Classifier, packing, pseudonyms, line dedup, Jaccard join and BPE against brute force and odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from vacantia.llm import alignment, bpe, jaccard, packing, pseudonyms, quality

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [(None, "some text without an id"), (1, None), (2, ""), (3, "   \n"), (4, "tie"), (4, "tie"), (5, "y " * 60_000)]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# quality

def test_ordinal_fit_orders_grades_and_generalises():
    rng = random.Random(1)
    features = quality.Featurizer(20)
    common = words(rng, 300).split()
    marks = [words(rng, 12).split() for _ in range(3)]  # telling words of each grade
    texts, grades = [], []
    for _ in range(900):
        g = rng.randrange(3)
        texts.append(" ".join(rng.choices(common, k=80) + rng.choices(marks[g], k=6)))
        grades.append(g)
    rows, grades = [features(t) for t in texts], np.array(grades)
    model = quality.fit_arrays(rows[:700], grades[:700], 3, bits=20)
    assert np.all(np.diff(model.cuts) > 0)
    tails = model.tails(np.array([model.latent(r) for r in rows[700:]]))
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert ((tails >= 0.5).sum(axis=1) == grades[700:]).mean() > 0.9


def test_scores_keep_every_row(docs, scratch):
    ratings = scratch.createDataFrame([(4, 2), (2, 0), (77, 1)], "doc_id long, grade int")
    model = quality.fit(docs(ODD), ratings, bits=12)
    scored = quality.score(docs(ODD), model).collect()
    assert len(scored) == len(ODD)
    assert all(0 <= r.p_good <= r.p_clean <= 1 for r in scored)
    assert len({r.p_good for r in scored if r.doc_id == 4}) == 1
    assert quality.score(docs([]), model).count() == 0
    nothing = quality.fit(docs([]), ratings.limit(0), bits=12)
    assert not nothing.weights.any()


def test_the_sample_stays_off_the_driver(docs, scratch, monkeypatch):
    """The driver gets a model, not the features it is fitted on; the model is that of a plain fit."""
    rng = random.Random(5)
    texts = [(i, words(rng, 40)) for i in range(60)]
    ratings = scratch.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    frame = type(ratings)
    plain, sent = frame.collect, []
    monkeypatch.setattr(frame, "toLocalIterator", lambda *a: pytest.fail("rows are read one by one"))
    monkeypatch.setattr(frame, "collect", lambda df: sent.extend(rows := plain(df)) or rows)
    model = quality.fit(docs(texts), ratings, bits=12)
    monkeypatch.undo()
    assert len(sent) == 1
    features = quality.Featurizer(12)
    expected = quality.fit_arrays([features(t) for _, t in texts], np.arange(60) % 3, 3, bits=12)
    assert model.weights.any() and np.array_equal(model.weights, expected.weights)
    assert np.array_equal(model.cuts, expected.cuts)


def test_held_out_accuracy(scratch):
    sf = "/root/testdata/sf0.01"
    documents = scratch.read.parquet(f"{sf}/documents.parquet")
    rated = quality.grades(scratch.read.parquet(f"{sf}/labels.parquet"))
    held = rated.filter("doc_id % 4 = 0")
    model = quality.fit(documents, rated.filter("doc_id % 4 <> 0"))
    got = quality.score(documents.join(held, "doc_id"), model).select("grade", "p_good").collect()
    assert np.mean([(r.p_good >= 0.5) == (r.grade == 2) for r in got]) > 0.8


# packing

@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_without_overlap(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
    placed, bins = Counter(), defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, offset in packing.plan(counts, capacity):
        placed[length] += n
        ranks[length].append((rank, n))
        for i in range(n):
            bins[first + i].append((offset, length))
    assert placed == Counter(counts)
    for spans in ranks.values():
        at = 0
        for rank, n in sorted(spans):
            assert rank == at
            at += n
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    # Never worse than best fit over single pieces, longest first.
    rooms, used = [], 0
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            used += 1
            rooms.append(capacity - length)
    assert len(bins) <= used * 1.02 + 1


def test_packed_pieces_match_the_tokenizer(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    rows = ODD + [(9, "a <|endoftext|> b"), (10, "line\n\n  two  spaces\t")]
    got = packing.pack(packing.pieces(docs(rows), JSON, P.PATTERN, capacity=512), capacity=512).collect()
    expected = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        start, size, piece = 0, (len(ids) - 1) % 512 + 1, 0
        while start < len(ids):
            raw = np.array(ids[start:start + size], dtype="<u4").tobytes()
            expected[doc_id, piece, start, size, zlib.crc32(raw)] += 1
            start, size, piece = start + size, 512, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1])
    assert packing.pack(packing.pieces(docs([]), JSON, P.PATTERN)).count() == 0


def test_ranks_of_the_vocabulary_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    encode, rng = packing.id_encoder(JSON, P.PATTERN), random.Random(3)
    parts = ["a", " ", "  ", "\n", "'s", "ß", "12", "!?", " ", "日本", "🙂", "<|endoftext|>", "²", "hello", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [f"a{chr(i)} {chr(i)}b" for i in range(1, 0x3000)]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == e.ids


# byte-level BPE

def reference_encoding():
    import base64

    import tiktoken
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library():
    expected, rng = reference_encoding(), random.Random(5)
    parts = ["a", "b", "the", " ", "  ", "\n", "'s", "ß", "é", "123", "...", " ", "日本", "🙂", "<|endoftext|>", "aaaaaaa", "﷐", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "\n \n"]
    encoder = bpe.TextEncoder(RANKS, P.PATTERN)
    encoder.by_words.pieces.limit = encoder.by_words.words.limit = 500  # forgets on the way
    for at in range(0, len(texts), 200):
        for text, ids in zip(texts[at:at + 200], encoder(texts[at:at + 200])):
            assert ids == expected.encode_ordinary(text)
            assert encoder.replay.decode(ids) == text.encode()


def test_bpe_frames_round_trip(docs):
    expected = reference_encoding()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs(ODD), RANKS, P.PATTERN).collect())
    want = Counter()
    for doc_id, text in ODD:
        ids = expected.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode(bpe.encode(docs(ODD), RANKS, P.PATTERN), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.raw)) for r in back) == Counter((i, (t or "").encode()) for i, t in ODD)


# pseudonyms

def test_personal_data_moves_within_its_format(docs):
    rows = [
        (1, "mail ann.lee-7@mail3.example.com and ANN.LEE-7@MAIL3.example.com, ip 10.0.0.255 not 300.1.1.1"),
        (2, "call +1 (017) 555-7713, (212) 555-1234 or 212-555-1234"),
        (3, "card 4111111111111111, 4111 1111 1111 1111; not 4111111111111112"),
        (4, "born 1984-02-29 29.02.1984 02/29/1984 but not 1983-02-29 or 2100-01-01"),
        (5, "ssn 123-45-6789 not 000-12-3456, iban DE89370400440532013000 GB82 WEST 1234 5698 7654 32 not DE89370400440532013001"),
        (6, "version 2.0 of 2024, page 17, 5 of 12"), (7, "again 4111111111111111 and ann.lee-7@mail3.example.com"),
    ]
    got = {r.doc_id: r for r in pseudonyms.pseudonymize(docs(rows), "k").collect()}
    text = {i: r.text for i, r in got.items()}
    assert [got[i].n_pseudonyms for i in range(1, 8)] == [3, 3, 2, 3, 3, 0, 2]
    assert text[6] == rows[5][1] and "300.1.1.1" in text[1] and "4111111111111112" in text[3]
    plain = text[3].split()[1].strip(",")
    assert plain != "4111111111111111" and luhn(plain) and plain in text[7]
    assert plain == "".join(text[3].split(";")[0].split()[2:6])
    mail = text[1].split()[1]
    assert mail in text[7] and mail.lower() == text[1].split()[3].strip(",").lower()
    assert text[2].startswith("call +1 (") and len(text[2]) == len(rows[1][1])
    assert "1983-02-29" in text[4] and "2100-01-01" in text[4] and "000-12-3456" in text[5]
    iban = text[5].split("iban ")[1].split()[0]
    assert iban.startswith("DE") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number[::-1])) % 10 == 0


def test_number_permutations_are_one_to_one(scratch):
    for left, right in ((17, 4297), (3, 7)):
        moved = scratch.range(left * right).select(pseudonyms.permuted_number(F.col("id"), left, right, "k", "t").alias("x"))
        assert moved.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first() == (left * right, 0, left * right - 1)
    strings = scratch.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    moved = strings.select(pseudonyms.permuted_chars(F.col("s"), "k", "t").alias("x")).distinct()
    assert moved.count() == 1000 and moved.filter("x rlike '^[0-9]{3}$'").count() == 1000


def test_pseudonyms_of_odd_rows(docs):
    got = pseudonyms.pseudonymize(docs(ODD), "k")
    assert Counter((r.doc_id, r.text, r.n_pseudonyms) for r in got.collect()) == Counter((i, t, 0) for i, t in ODD)
    assert pseudonyms.pseudonymize(docs([]), "k").count() == 0


# line dedup

def test_blocks_of_patience_diff():
    w = [30] * 9
    assert alignment.common_blocks([1, 2, 3, 4], [9, 1, 2, 8, 3, 4], w[:6], 50) == {1, 2, 4, 5}
    assert alignment.common_blocks([3, 4, 1, 2], [1, 2, 7, 3, 4], w[:5], 50) == {0, 1, 3, 4}  # moved
    assert alignment.common_blocks([1, 1, 2, 2], [1, 1, 2, 2], w[:4], 50) == {0, 1, 2, 3}  # nothing unique
    assert alignment.common_blocks([1, 5, 2], [1, 6, 2], w[:3], 50) == set()


def test_line_dedup_against_brute_force(docs):
    rng = random.Random(11)
    pool = [words(rng, rng.choice([5, 20, 55, 80])) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.5 else words(rng, 25) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            at = rng.randrange(25)
            lines += pool[at:at + 4]
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.n_deleted) for r in alignment.dedup_lines(docs(rows)).collect()}
    for i, text in rows:
        mine = text.split("\n")
        count, gone = [len(x.split()) for x in mine], set()
        for j, other in rows[:i]:
            theirs = other.split("\n")
            for a in range(len(mine)):
                for b in range(len(theirs)):
                    n = 0
                    while a + n < len(mine) and b + n < len(theirs) and mine[a + n] == theirs[b + n]:
                        n += 1
                    if sum(count[a:a + n]) >= 50:
                        gone |= set(range(a, a + n))
        assert got[i] == ("\n".join(x for k, x in enumerate(mine) if k not in gone), len(gone))


def test_line_dedup_of_odd_rows(docs):
    got = alignment.dedup_lines(docs(ODD + [(8, "y " * 60_000), (9, "y " * 60_000 + "\nend")]))
    text = {(r.doc_id, r.n_deleted): r.text for r in got.collect()}
    assert text[8, 1] == "" and text[9, 1] == "end" and text[5, 0] == "y " * 60_000
    assert got.count() == len(ODD) + 2 and text[None, 0] == ODD[0][1] and text[1, 0] is None
    assert got.columns[:3] == ["doc_id", "text", "n_chars"]
    assert alignment.dedup_lines(docs([])).count() == 0


# Jaccard join

def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_against_brute_force(docs):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([3, 30, 120]))) for i in range(60)]
    base = words(rng, 90).split()
    for i in range(60, 220):  # a large group of near copies, and copies among them
        edited = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            edited[rng.randrange(90)] = words(rng, 1)
        rows.append((i, " ".join(edited)))
    rows += [(300 + i, rows[i][1].upper()) for i in range(5)]
    rng.shuffle(rows)
    sets = {i: sets_of(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in sets}
    got = {r.doc_id: r for r in jaccard.similar_documents(docs(rows), leaf=8, block=32).collect()}
    assert len(got) == len(rows)
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].n_links == len(links[i])
        assert got[i].class_id == min(seen)
        assert got[i].copy_id == min(j for j in sets if sets[j] == sets[i])


def test_near_duplicates_of_odd_rows(docs):
    rows = docs(ODD)
    found = jaccard.similar_documents(rows)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in found.collect())
    assert got == Counter([(None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (4, 4, 1), (5, 5, 0)])
    assert Counter(r.doc_id for r in jaccard.one_per_class(rows, found).collect()) == Counter([None, 1, 2, 3, 4, 5])
    assert jaccard.similar_documents(docs([])).count() == 0


def test_merges_in_tables_are_those_of_the_linked_replay():
    rng, replay = random.Random(3), bpe.MergeReplay(RANKS)
    letters = [b"etaoin shrdlu", bytes(range(256)), "éàü日本ß ".encode(), b"aaab", b"0123.,"]
    asked = [bytes(rng.choice(x) for _ in range(rng.randrange(1, 45))) for x in letters for _ in range(300)]
    assert replay.encode([b"", *asked, b"a"]) == [[], *replay._encode_linked([*asked, b"a"])]
    lengths = {len(w) for w in asked}
    assert min(lengths) < bpe._WIDTHS[0] and max(lengths) > bpe._WIDTHS[-1]
    for width in bpe._WIDTHS:
        fit = [w for w in asked if len(w) <= width]
        assert replay._encode_table(fit, width) == replay._encode_linked(fit)
