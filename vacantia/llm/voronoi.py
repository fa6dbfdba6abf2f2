"""Exact top-k inner products as a Voronoi kNN join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.shared import map_served, written
from vacantia.llm.vectors import matrix, of_each_length, usable

#: Cells grow with the square root of the table, up to as many as may go through the driver.
MOST_PIVOTS = 4096
#: A component counts as this at most, before scaling would leave the doubles.
_GREATEST = 1e308
_LONG = 2**63 - 1


def _scaled(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double, which holds it exactly: above 2^52 every double is whole."""
    large = F.abs(x) >= 2.0**44
    bounded = F.greatest(F.least(x * scale, F.lit(_GREATEST)), F.lit(-_GREATEST))
    return F.when(large, bounded).otherwise(F.floor(x * scale).cast("double"))


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (points ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * points @ pivots.T
        far = np.sqrt(np.maximum(squares, 0))
    return np.where(np.isfinite(far), far, np.inf)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floats as long as every sum is below 2^53, else whole numbers.

    Sums beyond a long count as the largest one or its negative.
    """
    largest = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if largest < 2 ** 53:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    sums = whole(queries) @ whole(rows).T
    return np.vectorize(lambda v: max(-_LONG, min(_LONG, v)), otypes=[np.int64])(sums)


def top_products(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int | None = None,
    block_rows: int = 8000, block_queries: int = 256,
) -> DataFrame:
    """Each query's ``k`` highest inner products: ``(query_id, rank, vec_id, score)``.

    Components become floor(``scale`` * x). Queries are the rows whose id is divisible by
    ``every``, candidates all rows but the query itself; ties go to the smaller id. The search is exact.

    Rows and queries go to the cell of their nearest pivot, and a cell is summed up by its radius. A query
    is first answered in its own cell; its k-th score there is a bound. In a cell with pivot p and
    radius r no row scores more than q.p + |q| r, so the query is sent on to the cells that can
    still beat its bound, and to no others. Cells are cut into blocks of about ``block_rows`` rows; a
    block is held once and queries stream past it, ``block_queries`` at a time. Only queries are replicated, never rows.

    Which rows count is told in :func:`vacantia.llm.vectors.usable`; zero vectors do. Vectors are
    compared with others of their length only. An empty table or one without queries gives no rows.
    A score beyond a long counts as the largest long or its negative, before ranking. Pivots are the first
    rows by key hash, by default an eighth of the square root of the rows and at most ``MOST_PIVOTS``;
    they and a few numbers per cell go through the driver.
    """
    return of_each_length(vectors, lambda same: _top(same, k, every, scale, pivots, block_rows, block_queries))


def _top(
    vectors: DataFrame, k: int, every: int, scale: int, pivots: int | None, block_rows: int, block_queries: int,
) -> DataFrame:
    spark = vectors.sparkSession
    rows = written(
        usable(vectors, zero=True).select("vec_id", F.transform("embedding", lambda x: _scaled(x, scale)).alias("v")),
        "scaled",
    )
    pivots = pivots or min(MOST_PIVOTS, math.isqrt(rows.count()) // 8 + 1)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = matrix([r["v"] for r in chosen])

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _distances(matrix(batch["v"]), centres)
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell, far=far[np.arange(len(far)), cell])

    data = written(rows.mapInPandas(celled, "vec_id long, v array<double>, cell int, far double"), "cells")
    summary = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    blocks = {r["cell"]: -(-r["n"] // block_rows) for r in summary}
    radius = np.full(len(centres), -np.inf)  # a cell without rows
    for r in summary:
        radius[r["cell"]] = r["radius"]
    per_cell = F.broadcast(spark.createDataFrame(list(blocks.items()), "cell int, blocks int"))  # a row per pivot
    hosts = data.join(per_cell, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        F.lit(False).alias("is_query"), "vec_id", "v",
    )
    asked = data.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "cell")

    def answered(guests: DataFrame) -> DataFrame:
        """The k best of every (query, block) for queries sent to cells."""
        put = guests.join(per_cell, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(True).alias("is_query"), "vec_id", "v",
        )
        return map_served(hosts.unionByName(put), ["cell", "block"], "is_query", block, best,
                          "query_id long, vec_id long, score long")

    def block(held: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(held["vec_id"], kind="stable")
        return matrix(held["v"])[order], held["vec_id"][order]

    def best(state, guests: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
        points, row_ids = state
        queries, query_ids, out = matrix(guests["v"]), guests["vec_id"], []
        for at in range(0, len(queries), block_queries):
            some = slice(at, at + block_queries)
            for line, query_id in zip(_scores(queries[some], points), query_ids[some]):
                top = np.arange(len(line))
                if len(line) > k + 1:
                    least = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                    top = np.flatnonzero(line >= least)
                top = top[np.argsort(-line[top], kind="stable")]
                top = top[row_ids[top] != query_id][:k]
                out += [(int(query_id), int(row_ids[b]), int(line[b])) for b in top]
        return out

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = written(answered(asked), "home")
    bounds = home.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), "score")

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            queries = matrix(batch["v"])
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt((queries ** 2).sum(axis=1))[:, None]
                most = queries @ centres.T + norms * np.maximum(radius, 0)
                # Room for rounding: a bound may only be too high.
                most += 1e-9 * norms * (np.sqrt((centres ** 2).sum(axis=1)) + np.maximum(radius, 0)) + 1e-6
            most = np.where(np.isfinite(most), most, np.inf)
            least = batch["score"].to_numpy(dtype=np.float64, na_value=-np.inf)[:, None]
            # Bounds above 2^53 are rounded as doubles; what saturates is compared as equal.
            further = (most >= least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))) & np.isfinite(radius) | (radius == np.inf)
            further[np.arange(len(batch)), batch["cell"].to_numpy()] = False
            line, cell = np.nonzero(further)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].to_numpy()[line], "v": batch["v"].to_numpy()[line], "cell": cell})

    guests = asked.join(bounds, "vec_id", "left").mapInPandas(sent, "vec_id long, v array<double>, cell int")
    found = home.union(answered(guests))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
