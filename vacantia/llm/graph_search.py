"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.shared import map_served, written
from vacantia.llm.vectors import matrix, of_each_length, usable


class ProximityGraph:
    """A directed graph over the rows of a matrix.

    Every point is searched for greedily in the graph so far; what the search meets is offered to
    the point as neighbours, and robust pruning keeps a neighbour only if none kept before is
    closer to it, by the factor ``alpha``, than the point is. Kept edges are offered backwards, too.
    Points are inserted in groups, whose searches advance together as matrix operations.
    """

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 5):
        self.points = points.astype(np.float32)
        self.norms = (self.points ** 2).sum(1)
        self.degree, self.beam = degree, beam
        n = len(points)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        if n > 1:
            start = rng.integers(0, n, size=(n, min(degree, n - 1)))
            self.edges[:, :start.shape[1]] = np.where(start == np.arange(n)[:, None], (start + 1) % n, start)
        self.entry = int(((self.points - self.points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        for factor in (1.0, alpha):
            for part in np.array_split(rng.permutation(n), -(-n // 512)) if n > 1 else ():
                self._insert(part, factor)

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own list of ids; -1 is infinitely far."""
        dots = np.einsum("qd,qrd->qr", queries, self.points[ids])
        far = (queries ** 2).sum(1)[:, None] + self.norms[ids] - 2 * dots
        return np.where(ids < 0, np.float32(np.inf), far)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the ``beam`` nearest met, nearest first (-1: none)."""
        queries = queries.astype(np.float32)
        m = len(queries)
        ids = np.full((m, beam), -1, dtype=np.int32)
        far = np.full((m, beam), np.inf, dtype=np.float32)
        open_ = np.zeros((m, beam), dtype=bool)
        ids[:, 0] = self.entry
        far[:, 0] = self._distances(queries, ids[:, :1])[:, 0]
        open_[:, 0] = True
        seen = np.zeros((m, len(self.points)), dtype=bool)
        seen[:, self.entry] = True
        active = np.arange(m)
        while len(active):
            at = open_[active].argmax(axis=1)  # the nearest one not yet expanded
            open_[active, at] = False
            near = self.edges[ids[active, at]]
            known = seen[active[:, None], near] | (near < 0)
            near = np.where(known, -1, near)
            rows, columns = np.nonzero(near >= 0)
            seen[active[rows], near[rows, columns]] = True
            distance = self._distances(queries[active], near)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_far = np.concatenate([far[active], distance], axis=1)
            all_open = np.concatenate([open_[active], near >= 0], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            take = lambda x: np.take_along_axis(x, order, axis=1)
            ids[active], far[active] = take(all_ids), take(all_far)
            open_[active] = take(all_open) & np.isfinite(far[active])
            active = active[open_[active].any(axis=1)]
        return ids, far

    def _prune(self, owners: np.ndarray, ids: np.ndarray, far: np.ndarray, factor: float) -> np.ndarray:
        """Robust pruning of candidate lists (sorted by distance, -1 for none)."""
        kept = np.full((len(owners), self.degree), -1, dtype=np.int32)
        for at in range(0, len(owners), 256):
            some = slice(at, at + 256)
            cand, dist = ids[some], far[some]
            vectors = self.points[cand]
            gram = np.matmul(vectors, vectors.transpose(0, 2, 1))
            norms = self.norms[cand]
            between = norms[:, :, None] + norms[:, None, :] - 2 * gram
            alive = (cand >= 0) & (cand != owners[some][:, None]) & np.isfinite(dist)
            # The same id twice in a list: the first place counts.
            alive &= ~((cand[:, :, None] == cand[:, None, :]) & np.tri(cand.shape[1], k=-1, dtype=bool)).any(axis=2)
            number = np.zeros(len(cand), dtype=np.int64)
            rows = np.arange(len(cand))
            for c in range(cand.shape[1]):
                chosen = alive[:, c] & (number < self.degree)
                if not chosen.any():
                    continue
                who = rows[chosen]
                kept[at + who, number[who]] = cand[who, c]
                number[who] += 1
                alive[who] &= factor ** 2 * between[who, c, :] > dist[who]
                alive[who, c] = False
        return kept

    def _insert(self, part: np.ndarray, factor: float) -> None:
        met, far = self.search(self.points[part], self.beam)
        old = self.edges[part]
        ids = np.concatenate([met, old], axis=1)
        far = np.concatenate([far, self._distances(self.points[part], old)], axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        kept = self._prune(part, np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1), factor)
        self.edges[part] = kept
        # Backward edges: a target's list is its own edges and the new sources, pruned if too long.
        rows, columns = np.nonzero(kept >= 0)
        target, source = kept[rows, columns], part[rows].astype(np.int32)
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, int)
        counts = np.diff(np.r_[first, len(target)])
        for low, high in ((1, self.degree), (self.degree + 1, len(self.points) + 1)):
            some = (counts >= low) & (counts <= high)
            if not some.any():
                continue
            owners, starts, sizes = target[first[some]], first[some], counts[some]
            extra = np.full((len(owners), sizes.max()), -1, dtype=np.int32)
            line = np.repeat(np.arange(len(owners)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            extra[line, place] = source[np.repeat(starts, sizes) + place]
            ids = np.concatenate([self.edges[owners], extra], axis=1)
            far = self._distances(self.points[owners], ids)
            order = np.argsort(far, axis=1, kind="stable")
            ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
            width = int(np.isfinite(far).sum(axis=1).max())
            self.edges[owners] = self._prune(owners, ids[:, :width], far[:, :width], factor)


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 4000, degree: int = 32,
    beam: int = 128,
) -> DataFrame:
    """Each query's ``k`` nearest rows found: ``(query_id, rank, vec_id, score)``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query
    itself. ``score`` is the Euclidean distance in double precision, computed on the original vectors;
    ties go to the smaller id. Rows that take part: :func:`vacantia.llm.vectors.usable`, zero
    vectors left out.

    Equal vectors are one point of the graph, which remembers its k + 1 smallest ids (a query
    needs no more), so copies can neither crowd a graph nor a beam. Points are dealt by hash into
    shards of about ``shard_rows``; each shard builds its graph once, of all its points, and every query
    streams past it with a beam of ``beam``; the shards' findings are merged. A shard of few points is
    searched whole. No queries or an empty table give no rows. Vectors are compared with others of
    their length only.
    """
    return of_each_length(vectors, lambda same: _nearest(same, k, every, shard_rows, degree, beam))


def _nearest(vectors: DataFrame, k: int, every: int, shard_rows: int, degree: int, beam: int) -> DataFrame:
    rows = written(usable(vectors, zero=False), "vectors")
    point = F.xxhash64("embedding")
    salted = Window.partitionBy("point", "embedding", "salt").orderBy("vec_id")
    together = Window.partitionBy("point", "embedding").orderBy("vec_id")
    points = written(
        rows.withColumns({"point": point, "salt": F.pmod(F.xxhash64("vec_id"), F.lit(64))})
        .withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
        .withColumn("n", F.row_number().over(together)).filter(F.col("n") <= k + 1)
        .groupBy("point", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "points",
    )
    shards = max(1, -(-points.count() // shard_rows))
    queries = rows.filter(F.col("vec_id") % every == 0)
    dealt = points.select(
        F.pmod("point", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"),
        F.lit(0).cast("long").alias("vec_id"), "embedding", "ids",
    )
    put = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"),
        "vec_id", "embedding", F.lit(None).cast("array<long>").alias("ids"),
    )

    def built(shard: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, ProximityGraph]:
        vectors = matrix(shard["embedding"])
        return vectors, shard["ids"], ProximityGraph(vectors, degree)

    def searched(state, asked: dict[str, np.ndarray]) -> list[tuple[int, int, float]]:
        vectors, ids, graph = state
        queries, query_ids = matrix(asked["embedding"]), asked["vec_id"]
        out = []
        for at in range(0, len(queries), 256):
            some = queries[at:at + 256]
            found, _ = graph.search(some, min(beam, len(vectors)))
            for query, query_id, met in zip(some, query_ids[at:at + 256], found):
                met = np.unique(met[met >= 0])
                far = np.sqrt(((vectors[met] - query) ** 2).sum(axis=1))
                best = sorted(
                    (float(d), int(i)) for d, p in zip(far, met) for i in ids[p] if i != query_id
                )[:k]
                out += [(int(query_id), i, d) for d, i in best]
        return out

    found = map_served(
        dealt.unionByName(put), ["shard"], "is_query", built, searched, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
