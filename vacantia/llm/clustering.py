"""Integer k-means whose distance work is filtered in a PCA-rotated space.

Every vector is stored once with its leading rotated coordinates and the norm of what they leave
out. For a vector x and a centroid c the rotation gives

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

so most centroids are ruled out by a few coordinates; the survivors are compared in integers.
The rotation only decides how much is ruled out. Which centroid wins never depends on it.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import written

LONG_MAX = 2**63 - 1
#: Integers below this size give squared distances of 64 components that fit a long.
PLAIN = 2**27
#: Limb width of the exact sums that leave a task.
_LIMB = 32


@dataclass(frozen=True)
class Clustering:
    """Centroids as integers, and the vectors with ``cluster``, ``distance`` and ``verified``."""

    centroids: list[list[int]]
    assigned: DataFrame


def kept(vectors: DataFrame, components: int) -> DataFrame:
    """``(vec_id string, embedding)`` of the vectors that have the length and only finite components.

    Ids travel as text, so that a NULL among them changes no other id.
    """
    plain = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding").filter(F.size("embedding") == components)
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain.filter(~broken)


def _integer(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is beyond a double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def _integers(rows: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The floors as long integers, and which rows are too large for plain arithmetic."""
    with np.errstate(over="ignore"):
        floors = np.floor(rows * scale)
    large = ~(np.abs(floors) < PLAIN).all(axis=1)
    return np.where(large[:, None], 0, floors).astype(np.int64), large


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _rotation(vectors: DataFrame, components: int, scale: int, leading: int) -> np.ndarray:
    """The ``leading`` main axes of all vectors, as columns.

    Each task sends its sums of coordinates and products, component by component, so that only
    ``components * (components + 1) + 1`` sums reach the driver.
    """
    def sums(batches):
        total = np.zeros(1 + components + components * components)
        for batch in batches:
            whole, large = _integers(_matrix(batch["embedding"]), scale)
            x = whole[~large].astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"place": np.arange(len(total)), "part": total})

    parts = vectors.select("embedding").mapInPandas(sums, "place long, part double")
    found = {r["place"]: r["total"] for r in parts.groupBy("place").agg(F.sum("part").alias("total")).collect()}
    total = np.array([found.get(i, 0.0) for i in range(1 + components + components * components)])
    if not total[0]:
        return np.eye(components)[:, :leading]
    mean = total[1:components + 1] / total[0]
    spread = total[components + 1:].reshape(components, components) / total[0] - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :leading]


def rotated(vectors: DataFrame, components: int, scale: int, leading: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors written with ``lead`` and ``rest``, and the axes used."""
    axes = _rotation(vectors, components, scale, leading)

    def project(batches):
        for batch in batches:
            if not len(batch):
                continue
            whole, _ = _integers(_matrix(batch["embedding"]), scale)
            x = whole.astype(np.float64)
            lead = x @ axes
            rest = np.sqrt(np.maximum((x * x).sum(axis=1) - (lead * lead).sum(axis=1), 0))
            yield batch.assign(lead=list(lead), rest=rest)

    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"vec_id string, embedding {kind}, lead array<double>, rest double"
    return written(vectors.mapInPandas(project, schema), "rotated"), axes


class _Solver:
    """Nearest centroids of one batch."""

    def __init__(self, centroids: list[list[int]], axes: np.ndarray, scale: int):
        self.centroids, self.scale = centroids, scale
        self.plain = all(abs(v) < PLAIN for c in centroids for v in c)
        if self.plain:
            self.whole = np.array(centroids, dtype=np.int64)
            x = self.whole.astype(np.float64)
            self.lead = x @ axes
            self.norm = (x * x).sum(axis=1)
            self.rest = np.sqrt(np.maximum(self.norm - (self.lead * self.lead).sum(axis=1), 0))

    def nearest(self, batch: pd.DataFrame):
        """(cluster, distance, verified, integers) per row; distances of large rows are Python integers."""
        rows = _matrix(batch["embedding"])
        whole, large = _integers(rows, self.scale)
        size = len(batch)
        cluster, verified = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        distance = np.zeros(size, dtype=object)
        exact = {i: [_integer(float(v), self.scale) for v in rows[i]] for i in np.flatnonzero(large)}
        slow = list(exact) if self.plain else range(size)
        for i in slow:
            own = exact.get(i) or [int(v) for v in whole[i]]
            all_of = [sum((a - b) ** 2 for a, b in zip(own, c)) for c in self.centroids]
            cluster[i] = min(range(len(all_of)), key=lambda j: (all_of[j], j))
            distance[i], verified[i] = all_of[cluster[i]], len(all_of)
        if self.plain:
            fast = np.flatnonzero(~large)
            if len(fast):
                lead, rest = np.stack(batch["lead"].to_numpy()[fast]), batch["rest"].to_numpy()[fast]
                cluster[fast], distance[fast], verified[fast] = self._filtered(whole[fast], lead, rest)
        return cluster, distance, verified, whole, exact

    def _filtered(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray):
        norm = (lead * lead).sum(axis=1) + rest * rest
        bound = norm[:, None] - (rest * rest)[:, None] - 2 * lead @ self.lead.T + (self.lead * self.lead).sum(axis=1)
        bound += (rest[:, None] - self.rest) ** 2
        # Room for rounding: the bound may only rule out what is farther for certain.
        bound -= 1e-9 * (norm[:, None] + self.norm) + 1
        rows = np.arange(len(x))
        order = np.argmin(bound, axis=1)
        best = ((x - self.whole[order]) ** 2).sum(axis=1)
        cluster, verified = order.astype(np.int64), np.ones(len(x), dtype=np.int64)
        for j in range(len(self.whole)):
            left = rows[(bound[:, j] <= best) & (order != j)]
            if len(left):
                found = ((x[left] - self.whole[j]) ** 2).sum(axis=1)
                better = (found < best[left]) | ((found == best[left]) & (j < cluster[left]))
                best[left[better]], cluster[left[better]] = found[better], j
                verified[left] += 1
        return cluster, best, verified


def _limbs(value: int):
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & (2**_LIMB - 1))
        value >>= _LIMB
        place += 1


def _moved(stored: DataFrame, centroids: list[list[int]], axes: np.ndarray, scale: int) -> list[list[int]]:
    """The centroids after one round. Sums leave a task in limbs, so that they are exact at any size."""
    solver, width = _Solver(centroids, axes, scale), len(centroids[0])

    def sums(batches):
        total = [[0] * (width + 1) for _ in centroids]
        for batch in batches:
            if not len(batch):
                continue
            cluster, _, _, whole, exact = solver.nearest(batch)
            for j, row in enumerate(total):
                own = cluster == j
                row[width] += int(own.sum())
                for i, v in enumerate(whole[own].sum(axis=0).tolist()):
                    row[i] += v
            for i, values in exact.items():
                for place, v in enumerate(values):
                    total[cluster[i]][place] += v
        parts = [(j, i, limb, v) for j, row in enumerate(total) for i, value in enumerate(row) for limb, v in _limbs(value)]
        yield pd.DataFrame(parts, columns=["cluster", "place", "limb", "part"]).astype("int64")

    parts = stored.mapInPandas(sums, "cluster long, place long, limb long, part long")
    totals = [[0] * (width + 1) for _ in centroids]
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part")).collect():
        totals[r["cluster"]][r["place"]] += r["part"] << (_LIMB * r["limb"])
    return [[v // row[width] for v in row[:width]] if row[width] else old for row, old in zip(totals, centroids)]


def cluster(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024,
    seed: str = "3:", leading: int = 12,
) -> Clustering:
    """Lloyd's rounds on ``floor(scale * x)``, from the vectors whose hashed ids are smallest.

    Takes part: rows of ``(vec_id, embedding)`` with exactly ``components`` components, none NULL or
    non-finite; other rows are left out, other columns are not read. Repeated rows and ids count each;
    a NULL id counts as empty text in the hash, and equal hashes are ordered by the vectors. Fewer
    vectors than ``clusters`` give as many centroids as there are; an empty table gives none. A
    distance beyond a long is given as the largest long; the clusters are exact also then.

    Every round reads the stored vectors once and sends ``clusters * (components + 1)`` sums per task;
    nothing is shuffled by vector, so neither equal vectors nor one big cluster make a hot task.
    """
    usable = kept(vectors, components)
    start = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id"), F.lit(""))), 256)
    first = usable.orderBy(start, "embedding").limit(clusters).collect()
    centroids = [[_integer(float(v), scale) for v in r["embedding"]] for r in first]
    schema = "vec_id string, cluster int, distance long, verified int"
    own_id = F.col("vec_id").cast(vectors.schema["vec_id"].dataType)
    if not centroids:
        return Clustering([], vectors.sparkSession.createDataFrame([], schema).withColumn("vec_id", own_id))
    stored, axes = rotated(usable, components, scale, leading)
    for _ in range(rounds):
        centroids = _moved(stored, centroids, axes, scale)
    solver = _Solver(centroids, axes, scale)

    def assign(batches):
        for batch in batches:
            if len(batch):
                found, distance, verified, _, _ = solver.nearest(batch)
                yield pd.DataFrame({
                    "vec_id": batch["vec_id"], "cluster": found.astype(np.int32),
                    "distance": np.array([min(int(d), LONG_MAX) for d in distance], dtype=np.int64),
                    "verified": verified.astype(np.int32),
                })

    assigned = written(stored.mapInPandas(assign, schema), "clusters")
    return Clustering(centroids, assigned.withColumn("vec_id", own_id))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: Clustering) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; sums beyond a long are its largest."""
    assigned = found.assigned.drop("verified")
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    sums = {r["cluster"]: int(r["d"]) for r in summed}
    whole = min(sum(sums.values()), LONG_MAX)
    size = max(len(found.centroids), 1)
    place = F.col("cluster") + 1
    inertia = F.array(*[F.lit(min(sums.get(j, 0), LONG_MAX)).cast("long") for j in range(size)])
    digests = F.array(*[F.lit(digest(c)) for c in found.centroids] or [F.lit("")])
    return assigned.select(
        "*", F.element_at(inertia, place).alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"),
        F.element_at(digests, place).alias("centroid_sha256"),
    )
