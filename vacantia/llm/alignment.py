"""Line dedup by pairwise alignment: shared rare line runs, patience diff, deletion."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import fresh, written


def line_runs(hashes: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """For every start, and for every end, the shortest run of lines with ``least`` words: (start, end).

    Runs start and end at lines with words, so that a line lies in at most ``least`` runs either way,
    however many blank lines there are. Every line with words of a stretch with ``least`` words or
    more is in such a run inside the stretch.
    """
    def shortest(counts: list[int]) -> list[tuple[int, int]]:
        runs, end, total = [], 0, 0
        for start in range(len(counts)):
            while end < len(counts) and total < least:
                total += counts[end]
                end += 1
            if total < least:
                break
            if counts[start]:
                runs.append((start, end))
            total -= counts[start]
        return runs

    n = len(words)
    backward = [(n - end, n - start) for start, end in shortest(words[::-1])]
    return sorted({*shortest(words), *backward})


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first, that increases in the second (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[i] = piles[at - 1] if at else -1
        tops[at:at + 1] = [b]
        piles[at:at + 1] = [i]
    chain, i = [], piles[-1] if piles else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    return chain[::-1]


def common_blocks(
    a: list[int], b: list[int], words: list[int], least: int
) -> set[int]:
    """Line numbers of ``b`` in blocks that ``a`` has too and that hold at least ``least`` words.

    Patience diff: lines that occur once in either text anchor the alignment, the longest
    increasing chain of anchors is kept, and each anchor is extended over equal neighbours.
    Rounds are repeated without the lines already found, which catches moved blocks. What then
    still shares a run of ``least`` words (a text that repeats itself has no anchors) is matched by
    that run.
    """
    gone: set[int] = set()
    while True:
        alive = [j for j in range(len(b)) if j not in gone]
        in_a, in_b = Counter(a), Counter(b[j] for j in alive)
        spot = {h: i for i, h in enumerate(a) if in_a[h] == 1}
        anchors = sorted((spot[b[j]], j) for j in alive if in_b[b[j]] == 1 and b[j] in spot)
        found: set[int] = set()
        for i, j in _increasing(anchors):
            if j not in found:
                found |= _grown(a, b, words, i, j, least, gone)
        if not found:
            break
        gone |= found
    places: dict[tuple, int] = {}
    for start, end in line_runs(a, _words_of(a, b, words), least):
        places.setdefault(tuple(a[start:end]), start)
    for start, end in line_runs(b, words, least):
        at = places.get(tuple(b[start:end]))
        if at is not None and not gone.issuperset(range(start, end)):
            gone |= _grown(a, b, words, at, start, least, set())
    return gone


def _words_of(a: list[int], b: list[int], words: list[int]) -> list[int]:
    """Word counts for the lines of ``a`` as far as ``b`` knows them; others end every run."""
    known = dict(zip(b, words))
    return [known.get(h, 0) for h in a]


def _grown(a, b, words, i, j, least, stop) -> set[int]:
    low = 0
    while i - low > 0 and j - low > 0 and a[i - low - 1] == b[j - low - 1] and j - low - 1 not in stop:
        low += 1
    high = 0
    while i + high < len(a) and j + high < len(b) and a[i + high] == b[j + high] and j + high not in stop:
        high += 1
    block = range(j - low, j + high)
    return set(block) if sum(words[x] for x in block) >= least else set()


def dedup_lines(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """Deletes from later documents the blocks of lines they share with an earlier one.

    A block is a stretch of whole lines, equal and in the same order in both documents, with at
    least ``min_words`` words; "later" is the larger ``doc_id``. Returns all columns of the input, with
    the new ``text``, and ``n_deleted`` (lines). Columns of these names for own use are replaced.

    1. Each document gives the hashes of its shortest line runs of ``min_words`` words. Such a run is
       the rare line by which overlap shows: any line of a common block is in one. Every run is tied to the
       first document that has it, so a run shared by m documents gives m - 1 pairs, not m squared,
       and no run is too frequent to be used.
    2. Pairs meet on arrays of line hashes, not on texts, and are aligned one by one.
    3. The deleted line numbers of all its pairs are applied to the document at once.

    Rows with a NULL ``doc_id`` or text are returned as they are. Rows with equal ``doc_id`` and text are
    treated alike and are not compared with each other; of two rows with one ``doc_id`` and different
    texts neither is later, so lines they share stay. Lines end at ``\\n`` only.
    """
    own, gone = fresh(documents.columns, "row", "lost")
    docs = documents.withColumn(own, F.xxhash64("doc_id", "text"))
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def sign(value: bytes) -> int:
            return xxhash.xxh64_intdigest(value) - (1 << 63)

        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                lines = text.split("\n")
                words = [len(x.split()) for x in lines]
                if sum(words) < min_words:
                    continue
                hashes = [sign(x.encode("utf-8", "surrogatepass")) for x in lines]
                runs = [
                    sign(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes[s:e]))
                    for s, e in line_runs(hashes, words, min_words)
                ]
                out.append((doc_id, row, hashes, words, runs))
            yield pd.DataFrame(out, columns=["doc_id", "row", "hashes", "words", "runs"])

    lined = written(
        usable.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
            lines_of,
            "doc_id long, row long, hashes array<long>, words array<int>, runs array<long>",
        ),
        "lines",
    )
    runs = lined.select("doc_id", "row", F.explode(F.array_distinct("runs")).alias("run"))
    first = runs.groupBy("run").agg(
        F.min(F.struct("doc_id", "row")).alias("first"),
        F.max(F.struct("doc_id", "row")).alias("last"),
    ).filter("first.row <> last.row")
    pairs = written(
        runs.join(first, "run").filter("row <> first.row and doc_id > first.doc_id")
        .select("row", F.col("first.row").alias("earlier")).distinct(),
        "pairs",
    )
    lines = lined.select("row", "hashes", "words").distinct()

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, a, b, words in zip(batch["row"], batch["a"], batch["b"], batch["words"]):
                lost = common_blocks(a.tolist(), b.tolist(), words.tolist(), min_words)
                if lost:
                    out.append((row, sorted(lost)))
            yield pd.DataFrame(out, columns=["row", "lost"])

    matched = (
        pairs.join(lines, "row")
        .join(lines.select(F.col("row").alias("earlier"), F.col("hashes").alias("a")), "earlier")
        .select("row", "a", F.col("hashes").alias("b"), "words")
        .mapInPandas(aligned, "row long, lost array<int>")
    )
    # Gathered per document: at most one entry for each of its own lines and pairs.
    lost = matched.select("row", F.explode("lost").alias("line")).distinct().groupBy("row").agg(
        F.collect_list("line").alias("lines")
    )
    # Numbers of the lines that stay, by a hash set; the lines are cut once.
    kept_lines = F.transform(F.array(F.split("text", "\n", -1)), lambda cut: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone), lambda i: F.get(cut, i)), "\n"))[0]
    joined = docs.drop("n_deleted").join(
        written(lost, "lost").select(F.col("row").alias(own), F.col("lines").alias(gone)).hint("shuffle_hash"),
        own, "left",
    )
    return joined.select(
        *[
            F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept_lines).alias("text")
            if c == "text" else F.col(f"`{c}`")
            for c in documents.columns if c != "n_deleted"
        ],
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias("n_deleted"),
    )
