"""Inverted index over posting text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import constants as C
from vacantia.functions.text import split_words, tokens
from vacantia.operators.keywords import Condition, field_texts

POSTING_COLUMNS = ["token", "field", "job_id", "positions"]
#: Tokens that are put in order together inside a task.
TOKENS_AT_ONCE = 1_000_000


def build_index(
    jobs: DataFrame, key: str = "job_id", fields: Sequence[str] = C.INDEXED_FIELDS,
    only: Condition | None = None, group: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(token, field, key, positions): one row per distinct token of a field.

    All occurrences of a token in one field lie in one input row, so the lists are built there:
    the index needs no shuffle, and a token found everywhere is never gathered anywhere. With
    ``only``, just the entries one condition asks for, for a search without a stored index. All entries
    come in runs that are in order by ``group``, a whole number per token, and token: a sort by both
    has little left to do.
    """
    texts = field_texts(jobs, fields)
    if only is None:
        return _all_entries(jobs, key, texts, group)
    parts = [
        F.struct(F.lit(name).alias("field"), _positions(tokens(text), only).alias("entries"))
        for name, text in texts.items()
    ]
    per_field = jobs.select(key, F.explode(F.array(*parts)).alias("_f"))
    entries = per_field.select(key, F.col("_f.field").alias("field"), F.explode("_f.entries").alias("_e"))
    return entries.select("_e.token", "field", key, "_e.positions")


def _all_entries(
    jobs: DataFrame, key: str, texts: dict[str, Column], group: Callable[[Column], Column] | None
) -> DataFrame:
    """The entries of all words, built a batch of rows at a time from columns of words."""
    names = list(texts)
    cut = jobs.select(F.col(key), *[split_words(text).alias(f"_w{i}") for i, text in enumerate(texts.values())])
    schema = T.StructType([
        T.StructField("token", T.StringType()), T.StructField("field", T.StringType()),
        T.StructField(key, cut.schema[0].dataType), T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])
    if group is not None:
        cut = cut.select("*", *[F.transform(f"_w{i}", group).alias(f"_g{i}") for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(names):
                words = batch.column(i + 1)
                groups = None if group is None else batch.column(i + 1 + len(names))
                ends = np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(words):
                    done = ends[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(ends, done + TOKENS_AT_ONCE, side="right")))
                    part = None if groups is None else groups.slice(at, end - at)
                    rows, token, positions = _runs(words.slice(at, end - at), part)
                    yield pa.RecordBatch.from_arrays(
                        [token, pa.repeat(name, len(rows)), batch.column(0).take(pa.array(rows + at)), positions],
                        names=["token", "field", key, "positions"],
                    )
                    at = end

    return cut.mapInArrow(run, schema)


def _runs(words: pa.ListArray, groups: pa.ListArray | None) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """Per row and distinct word: the row, the word and its places; the empty words beside separators don't count."""
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
    flat = words.flatten()
    real = pc.not_equal(flat, "")
    kept = real.to_numpy(zero_copy_only=False)
    flat, row = flat.filter(real), row[kept]
    known = flat.dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False)
    word = known.dictionary
    by_word = pc.sort_indices(word).to_numpy()
    if groups is not None:
        of = np.zeros(len(word), dtype=np.int64)
        of[code] = groups.flatten().to_numpy(zero_copy_only=False)[kept]
        by_word = by_word[np.argsort(of[by_word], kind="stable")]
    rank = np.empty(len(word), dtype=np.int64)
    rank[by_word] = np.arange(len(word))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    which = rank[code] * len(words) + row
    order = np.argsort(which, kind="stable")
    heads = np.flatnonzero(np.diff(which[order], prepend=-1))
    offsets = np.append(heads, len(order)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype(np.int32)))
    first = order[heads]
    return row[first], word.take(pa.array(code[first])), positions


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _positions(words: Column, only: Condition) -> Column:
    """Array of (token, positions) of the asked ones in an array of tokens: sort, then cut into equal runs."""
    placed = F.transform(words, lambda token, at: F.struct(token.alias("token"), at.alias("at")))
    ordered = F.sort_array(F.filter(placed, lambda item: only.asks_for(item["token"])))

    def cut(items: Column) -> Column:
        def is_head(item: Column, i: Column) -> Column:
            return (i == 0) | (item["token"] != F.get(items, i - 1)["token"])

        heads = F.array_compact(F.transform(items, lambda item, i: F.when(is_head(item, i), i)))
        return _bound(heads, lambda starts: F.transform(starts, lambda start, n: run(items, starts, start, n)))

    def run(items: Column, starts: Column, start: Column, n: Column) -> Column:
        end = F.coalesce(F.get(starts, n + 1), F.size(items))
        return F.struct(
            F.get(items, start)["token"].alias("token"),
            F.slice(items, start + 1, end - start)["at"].alias("positions"),
        )

    return _bound(ordered, cut)


def refresh_index(
    index: DataFrame, touched: DataFrame, key: str = "job_id",
    fields: Sequence[str] = C.INDEXED_FIELDS,
) -> DataFrame:
    """Entries of touched postings are recomputed, all others stay."""
    kept = index.join(touched.select(key), key, "left_anti")
    return kept.unionByName(build_index(touched, key, fields))


def drop_from_index(index: DataFrame, removed: DataFrame, key: str = "job_id") -> DataFrame:
    return index.join(removed.select(key), key, "left_anti")


def write_index(
    index: DataFrame, path: str, buckets: int = 64, files_per_bucket: int = 8, key: str = "job_id"
) -> None:
    """Store by token hash, sorted by token, so a search opens few row groups.

    Postings of one token are spread over ``files_per_bucket`` files by key: no writer gets a
    word that stands in every posting whole. Raise it with the number of postings.
    """
    (
        index.withColumn("token_bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        .repartition("token_bucket", F.pmod(F.xxhash64(key), F.lit(files_per_bucket)))
        .sortWithinPartitions("token_bucket", "token")
        .write.mode("overwrite").partitionBy("token_bucket")
        .option("partitionOverwriteMode", "static").parquet(path)
    )


# Tasks get these functions by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
