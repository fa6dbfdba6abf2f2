"""What the vector searches share: usable vectors, one row per id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_each_length(vectors: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The search, done for the vectors of each length by themselves; only these can be compared.

    The lengths come to the driver; a table holds few. Without any vector the search sees none.
    """
    size = F.size("embedding")
    found = vectors.filter("embedding IS NOT NULL").select(size.alias("n")).distinct().collect()
    lengths = sorted(r["n"] for r in found if r["n"] > 0)
    parts = [search(vectors.filter(size == n)) for n in lengths] or [search(vectors.limit(0))]
    return reduce(DataFrame.unionByName, parts)


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """``(vec_id, embedding array<double>)`` of the rows that take part, one per id.

    Left out are NULL ids, NULL vectors, vectors with NULL or non-finite components, empty ones,
    and zero ones unless ``zero``. Of several vectors with one id the smallest counts.
    """
    plain = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = plain.filter(~bad)
    if not zero:
        plain = plain.filter(F.exists("embedding", lambda x: x != 0))
    return plain.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pd.Series | np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])
