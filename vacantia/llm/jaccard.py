"""N-gram Jaccard join by chosen paths, with exact verification of every link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import components, map_groups, written

TOKENS = 128          # sampled tokens (minima of as many hash functions) of a set
_CACHE_LIMIT = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Text → sorted distinct 64-bit hashes of its ``n`` word runs.

    Words are what white space separates, in lower case. A text of fewer words is one shingle of
    all of them; a text without words has none.
    """

    def __init__(self, n: int = 5):
        self.n = n
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").lower().split()
        known = self.known
        if len(known) > _CACHE_LIMIT:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.n, len(hashes))
        if not width:
            return hashes
        with np.errstate(over="ignore"):
            total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
            for i in range(width):
                total = _mixed(total * np.uint64(31) + hashes[i:len(hashes) - width + 1 + i] + _MIX)
        return np.unique(total)


_SEEDS = _mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each of the hash functions the least value over the set, as 32 bits."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            spread = (shingles[at:at + 1024, None] ^ (shingles[at:at + 1024, None] >> np.uint64(29))) * _SEEDS
            np.minimum(least, spread.min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    with np.errstate(over="ignore"):
        one = int(_mixed(shingles).sum(dtype=np.uint64).astype(np.int64))
        two = int(np.bitwise_xor.reduce(_mixed(shingles * _MIX)).astype(np.int64)) if len(shingles) else 0
    return one, two


def _sets(documents: DataFrame, n: int) -> DataFrame:
    """One row per document: key, size and 128-bit hash of its shingle set, and its sampled tokens."""
    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles_of = Shingler(n)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingles_of(text)
                one, two = _signature(s)
                if not len(s):
                    out.append((doc_id, 0, one, two, b"", b""))
                    continue
                least = minima(s)
                low = np.packbits((least & 1).astype(np.uint8)).tobytes()
                out.append((doc_id, len(s), one, two, least.tobytes(), low))
            yield pd.DataFrame(out, columns=["doc_id", "size", "h1", "h2", "tokens", "bits"])

    return documents.select("doc_id", "text").mapInPandas(
        sketched, "doc_id long, size int, h1 long, h2 long, tokens binary, bits binary"
    )


def _token(at: Column) -> Column:
    """Sampled token number ``at`` of a set, as hex text."""
    return F.hex(F.col("tokens").substr(at * 4 + 1, F.lit(4)))


def _buckets(sets: DataFrame, runs: int, leaf: int, depth: int, fanout: int) -> DataFrame:
    """Chosen paths: rows ``(bucket, node, bits, size, shape)`` of all leaves with two sets or more.

    Run r starts by splitting all sets on sampled token r. A bucket of at most ``leaf`` sets is a
    leaf. A larger one is split again on ``fanout`` tokens, which its path chooses, a set going down
    every branch; a split that leaves most of its parent together will not help and ends there, as
    does one at ``depth``. Such leaves may be of any size and are compared in blocks.
    """
    level = sets.select(
        "node", "bits", "tokens",
        F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"),
    ).select(
        "node", "bits", "tokens", F.lit(None).cast("long").alias("parent_rows"),
        F.xxhash64("run", _token(F.col("run") * 7 % TOKENS)).alias("bucket"),
    )
    leaves = None
    for step in range(depth + 1):
        sized = level.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("rows"), F.max("parent_rows").alias("parent_rows")
        ).filter("rows > 1")
        done = (F.col("rows") <= leaf) | F.coalesce(
            F.col("rows") > 0.7 * F.col("parent_rows"), F.lit(False)
        )
        if step == depth:
            done = F.lit(True)
        sized = sized.withColumn("done", done)
        here = written(
            level.drop("parent_rows", "tokens").join(sized, "bucket")
            .select("bucket", "node", "bits", "rows", "done"), f"paths-{step}",
        )
        ended = here.filter("done").select("bucket", "node", "bits", "rows")
        leaves = ended if leaves is None else leaves.union(ended)
        if step == depth or here.filter("NOT done").isEmpty():
            break
        level = (
            here.filter("NOT done").select("bucket", "node", F.col("rows").alias("parent_rows"))
            .join(sets.select("node", "tokens", "bits"), "node")
            .withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
            .withColumn("at", F.pmod(F.xxhash64("bucket", "branch"), F.lit(TOKENS)).cast("int"))
            .select(
                "node", "bits", "tokens", "parent_rows",
                F.xxhash64("bucket", "branch", _token(F.col("at"))).alias("bucket"),
            )
        )
    return leaves


def in_blocks(rows: DataFrame, group: str, count: str, block: int, node: str) -> DataFrame:
    """Repeats rows so that any two rows of a group meet in one task of at most two blocks.

    A group of b blocks makes b (b + 1) / 2 tasks, and a row goes to b of them; a group within
    one block makes one. Adds ``block_a <= block_b`` and ``block``, the row's own block.
    """
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), node), blocks).cast("int")
    return (
        rows.withColumn("blocks", blocks).withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
        .drop("blocks", "other")
    )


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links to keep what they connect connected: at most n - 1."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = top(a), top(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            edges.append((a, b))
    return edges


def _candidates(leaves: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges between sets whose one-bit sketches agree enough; a spanning forest per leaf block.

    Two sets of similarity J agree in (1 + J) / 2 of the bits; 4.5 standard deviations are left for chance.
    """
    share = (1 + threshold) / 2
    least = TOKENS * share - 4.5 * (TOKENS * share * (1 - share)) ** 0.5

    def compared(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        raw = np.frombuffer(b"".join(group["bits"]), dtype=np.uint8).reshape(len(group["bits"]), -1)
        signs = np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1
        own, a, b = group["block"], group["block_a"][0], group["block_b"][0]
        rows, columns = np.flatnonzero(own == a), np.flatnonzero(own == b)
        lefts, rights = [np.empty(0, dtype=int)], [np.empty(0, dtype=int)]
        for at in range(0, len(rows), 512):
            part = rows[at:at + 512]
            x, y = np.nonzero((signs[part] @ signs[columns].T + TOKENS) / 2 >= least)
            i, j = part[x], columns[y]
            keep = i < j if a == b else i != j
            lefts.append(i[keep])
            rights.append(j[keep])
        node = group["node"].tolist()
        edges = _forest(len(node), np.concatenate(lefts), np.concatenate(rights))
        return [(node[i], node[j]) for i, j in edges]

    spread = in_blocks(leaves, "bucket", "rows", block, "node").select(
        "bucket", "block_a", "block_b", "block", "node", "bits"
    )
    return map_groups(spread, ["bucket", "block_a", "block_b"], compared, "a long, b long").distinct()


def _verified(active: DataFrame, threshold: float, block: int) -> DataFrame:
    """Exact comparison inside candidate components: links per set, and edges that span them.

    Rows ``(node, links, other)``: with ``other`` NULL a count of linked documents, else an edge.
    """
    def compared(group: dict[str, np.ndarray]) -> list[tuple[int, int, int | None]]:
        # A document id on several equal rows gives its set several times.
        _, first = np.unique(group["node"], return_index=True)
        own, a, b = group["block"][first], group["block_a"][0], group["block_b"][0]
        sets = [np.frombuffer(group["shingles"][i], dtype=np.uint64) for i in first]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        node, copies = group["node"][first], group["copies"][first]
        links = np.zeros(len(sets), dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        # Only shingles of two sets or more count: dense columns for these, in parts.
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        lengths = np.diff(np.r_[starts, len(flat)])
        use = lengths > 1
        column = np.repeat(np.cumsum(use) - 1, lengths)
        keep = np.repeat(use, lengths)
        column, owner = column[keep], owner[keep]
        shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
        distinct = int(use.sum())
        for begin in range(0, distinct, 4096):
            at = (column >= begin) & (column < begin + 4096)
            dense = np.zeros((len(sets), min(4096, distinct - begin)), dtype=np.float32)
            dense[owner[at], column[at] - begin] = 1
            shared += dense @ dense.T
        i, j = np.nonzero(np.triu(shared, 1))
        both = shared[i, j]
        # |A and B| / |A or B| >= t, on whole numbers up to rounding of t.
        similar = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        if a != b:
            similar &= own[i] != own[j]
        i, j = i[similar], j[similar]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        out = [(int(node[x]), int(links[x]), None) for x in np.flatnonzero(links)]
        return out + [(int(node[x]), 0, int(node[y])) for x, y in _forest(len(sets), i, j)]

    spread = in_blocks(active, "component", "members", block, "node").select(
        "component", "block_a", "block_b", "block", "node", "copies", "shingles"
    )
    return map_groups(
        spread, ["component", "block_a", "block_b"], compared, "node long, links long, other long"
    )


def similar_documents(
    documents: DataFrame, threshold: float = 0.8, shingle_words: int = 5, runs: int = 12,
    leaf: int = 100, depth: int = 3, fanout: int = 2, block: int = 256,
) -> DataFrame:
    """Near duplicates: ``(doc_id, copy_id, class_id, n_links)``, one row per document row.

    Two documents are linked if the Jaccard similarity of their shingle sets is ``threshold`` or
    more. ``copy_id`` is the smallest id among documents with the same set, ``class_id`` the smallest
    id that links lead to, ``n_links`` the number of other rows linked directly.

    Copies are joined first, by a hash of the whole set, and go on as one set. Candidates come
    from ``runs`` repeated chosen paths. A run keeps a pair of similarity 0.8 together with
    probability 0.8 where its first bucket is a leaf, and 0.71 or more through all splits, so
    twelve runs miss at most four pairs in ten million. Whatever candidates connect is then
    compared exactly, on whole shingle sets, in blocks of bounded size.

    Documents without words (NULL, empty, white space) and rows with NULL ``doc_id`` have no links
    and are classes of their own. A ``doc_id`` on several rows with different texts counts as one
    document with several sets: each row has its set's class.
    """
    everything = written(_sets(documents.filter("doc_id IS NOT NULL"), shingle_words), "sets")
    sets = everything.filter("size > 0")
    key = ["size", "h1", "h2"]
    copies = written(
        sets.groupBy(*key).agg(
            F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"),
            F.first("tokens").alias("tokens"), F.first("bits").alias("bits"),
        ).withColumn("node", F.xxhash64(*key)),
        "copies",
    )
    leaves = _buckets(copies.select("node", "tokens", "bits"), runs, leaf, depth, fanout)
    maybe = components(_candidates(leaves, threshold, 4 * block))
    maybe = written(maybe, "candidates")
    members = maybe.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    active = (
        copies.select("node", "copy_id", "copies", *key)
        .join(maybe, "node").join(members, "component")
    )

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles_of = Shingler(shingle_words)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                found = [shingles_of(t) for t in part["text"]]
                same = [_signature(s) == (one, two) for s, one, two in zip(found, part["h1"], part["h2"])]
                yield part.assign(shingles=[s.tobytes() for s in found])[same].drop(
                    columns=["text", "h1", "h2"]
                )

    # The set is computed again from the text of one copy, so that only active sets are moved.
    chosen = sets.join(active, key).filter("doc_id = copy_id").groupBy(
        "node", "copies", "component", "members", "h1", "h2"
    ).agg(F.min("doc_id").alias("doc_id"))
    texts = (
        documents.select("doc_id", "text")
        .join(chosen.hint("shuffle_hash"), "doc_id")
        .select("node", "copies", "component", "members", "h1", "h2", "text")
        .mapInPandas(shingled, "node long, copies long, component long, members long, shingles binary")
    )
    checked = written(_verified(texts, threshold, block), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(checked.filter("other IS NOT NULL").select(
        F.col("node").alias("a"), F.col("other").alias("b")
    ))
    named = copies.select("node", "copy_id", "copies", *key).join(links, "node", "left").join(
        grouped, "node", "left"
    )
    least = named.filter("component IS NOT NULL").groupBy("component").agg(
        F.min("copy_id").alias("class_id")
    )
    classes = named.join(least, "component", "left").select(
        *key, "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    with_words = sets.select("doc_id", *key).join(classes, key).select(
        "doc_id", "copy_id", "class_id", "n_links"
    )
    blank = everything.filter("size = 0").select("doc_id").union(
        documents.filter("doc_id IS NULL").select("doc_id")
    ).select(
        "doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return with_words.unionByName(blank)


def one_per_class(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that stand for their class: its smallest id.

    Equal rows of that id are copies, too, and one of them stays. Rows with NULL ids stay.
    """
    gone = found.filter("doc_id <> class_id").select("doc_id").distinct()
    rows = found.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    once = kept.join(rows, "doc_id", "left_anti").select(*documents.columns)
    return once.union(kept.join(rows, "doc_id", "left_semi").select(*documents.columns).dropDuplicates())
