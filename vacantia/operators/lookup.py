"""Joins against a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot. It bounds what is broadcast and repeated:
#: at most 1 / HOT_SHARE keys are hot, and they are given fewer than 2 / HOT_SHARE copies together.
HOT_SHARE = 1 / 1024
#: Counters of the sketch per share searched for; its error is then a small part of the share.
COUNTERS_PER_SHARE = 8
_SALT = "_salt"
_HASH = "_key_hash"
_COPIES = "_copies"


def hot_keys(facts: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """``(_key_hash, _copies)`` of the keys that hold more than ``share`` of the rows.

    A frequent-items sketch (Misra-Gries counters of a fixed number, merged over the tasks) over the
    hash of the key columns: one pass that reads these columns only. No hot key is missed, as the
    sketch's error stays below the share; a key just under it may be taken for hot, which costs
    a few copies. NULL is a key like others. ``_copies`` is the number of parts, each of about
    ``share`` of the rows.
    """
    if not 1 / 100_000 <= share < 1:
        raise ValueError("share must lie between 0.00001 and 1")
    wanted = round(1 / share)
    sketch = facts.select(F.xxhash64(*keys).alias(_HASH)).agg(
        F.expr(f"approx_top_k({_HASH}, {2 * wanted}, {COUNTERS_PER_SHARE * wanted})").alias("_top"),
        F.count(F.lit(1)).alias("_rows"),
    )
    found = sketch.select(F.explode("_top").alias("_item"), "_rows").select(
        F.col("_item.item").alias(_HASH),
        F.ceil(F.col("_item.count") / (F.col("_rows") * F.lit(share))).cast("int").alias(_COPIES),
    )
    return found.filter(F.col(_COPIES) > 1)


def lookup(
    facts: DataFrame,
    entries: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread_by: str | Sequence[str] | None = None,
    salts: int | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Join many fact rows per key to at most one entry row per key.

    With ``spread_by`` (columns that vary within a key) the rows of hot keys are spread over several
    shuffle partitions, so a key that holds a third of all facts is never one task. Which keys are
    hot, and over how many parts they go, is found in the facts themselves (:func:`hot_keys`); the
    entries of these keys alone are repeated, fewer than ``2 / hot_share`` rows in all, so entries may
    be as many as the facts. All other rows are joined as in a plain join. ``salts`` spreads every
    key over that many parts instead, without a look at the facts.

    ``how`` is inner, left, left_semi or left_anti: a repeated entry without facts would come back
    several times from the others.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not spread_by:
        return facts.join(entries, keys, how)
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "left_anti", "leftanti"):
        raise ValueError(f"a spread join cannot be {how}")
    spread = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    part = F.xxhash64(*spread)
    if salts is not None:
        salted = facts.withColumn(_SALT, F.pmod(part, F.lit(salts)).cast("int"))
        repeated = entries.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)
    hot = F.broadcast(hot_keys(facts, keys, hot_share))
    copies = F.coalesce(_COPIES, F.lit(1))
    salted = (
        facts.withColumn(_HASH, F.xxhash64(*keys)).join(hot, _HASH, "left")
        .withColumn(_SALT, F.pmod(part, copies).cast("int"))
    )
    repeated = (
        entries.withColumn(_HASH, F.xxhash64(*keys)).join(hot, _HASH, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop(_HASH, _COPIES)
    )
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT, _HASH, _COPIES)
