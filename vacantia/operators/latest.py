"""Last row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(
    rows: DataFrame, key: str | Sequence[str], order: str | Sequence[str]
) -> DataFrame:
    """The row with the greatest order per key.

    Written as an aggregate rather than a ranking window: each task reduces its rows to one
    per key before the shuffle, so a hot key costs one row per task and is never sorted whole.
    The order columns must be unique within a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in rows.columns if c not in keys]
    winner = F.max_by(F.struct(*rest), F.struct(*orders)).alias("_row")
    return rows.groupBy(*keys).agg(winner).select(*keys, "_row.*").select(*rows.columns)
