"""A table in one folder per day, from which old days are dropped without rewriting the rest.

    <path>/data/version=<v>/day=<yyyy-mm-dd>   the rows of a day as version v left them
    <path>/manifest                            a JSON row per version: the version of each day

Rows without a time lie in a day of their own, which retention never touches. As in
:mod:`vacantia.operators.stored_table`, files count once a manifest names them. One writer.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.times import instant, seconds_before
from vacantia.operators.stored_table import StoredTable, path_exists

DAY, UNKNOWN = "day", "unknown"
_MANIFEST = "version long, body string"


@dataclass(frozen=True)
class DayTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    time: str
    version: int = 0
    days: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def open(spark: SparkSession, path: str, schema: T.StructType, key: str = "job_id", time: str = "scraped_at") -> DayTable:
        table = DayTable(spark, path, schema, key, time)
        if not path_exists(spark, f"{path}/manifest"):
            return table
        row = spark.read.schema(_MANIFEST).json(f"{path}/manifest").orderBy(F.desc("version")).first()
        return DayTable(spark, path, schema, key, time, row["version"], tuple(map(tuple, json.loads(row["body"]))))

    def read(self, only: Sequence[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/{DAY}={d}" for d, v in self.days if only is None or d in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, rows: DataFrame, files_per_day: int = 8) -> DayTable:
        """The table with these rows as well; days that it has already are written anew with both."""
        day = F.coalesce(F.date_format(self.time, "yyyy-MM-dd"), F.lit(UNKNOWN))
        named = rows.select(*self.schema.names).withColumn(DAY, day)
        new = [r[0] for r in named.select(DAY).distinct().collect()]
        both = self.read(new).withColumn(DAY, day).unionByName(named)
        return self._committed({**dict(self.days), **self._written(both, files_per_day)})

    def delete_older(self, as_of, max_age_seconds: int) -> tuple[DayTable, DataFrame, int]:
        """The table without rows older than the limit, their keys, and how many they were.

        Days wholly before the limit leave the manifest; only their key column is read, for the rows
        that hang on them. Of the day the limit falls in, the rest is written anew. All other days are
        neither read nor written.
        """
        limit = self.spark.range(1).select(seconds_before(instant(as_of), max_age_seconds).alias("t")).first()["t"]
        border = limit.strftime("%Y-%m-%d")
        past = [d for d, _ in self.days if d != UNKNOWN and d < border]
        is_old = F.col(self.time) < F.lit(limit).cast(self.schema[self.time].dataType)
        old = self.read(past).select(self.key).union(self.read([border]).filter(is_old).select(self.key))
        count = old.count()
        if not count:
            return self, old, 0
        left = self.read([border]).filter(~is_old).withColumn(DAY, F.lit(border))
        kept = {d: v for d, v in self.days if d not in past and d != border}
        written = {} if left.isEmpty() else self._written(left, 8)
        return self._committed({**kept, **written}), old, count

    def _written(self, named: DataFrame, files_per_day: int) -> dict[str, int]:
        version = self.version + 1
        target = f"{self.path}/data/version={version}"
        (
            named.repartition(F.col(DAY), F.pmod(F.xxhash64(self.key), F.lit(files_per_day)))
            .sortWithinPartitions(DAY, self.key).write.mode("overwrite").option("partitionOverwriteMode", "static")
            .partitionBy(DAY).parquet(target)
        )
        days = self.spark.read.schema(T.StructType([T.StructField(DAY, T.StringType())])).parquet(target).distinct().collect()
        return {r[0]: version for r in days}

    def _committed(self, days: dict[str, int]) -> DayTable:
        version, listed = self.version + 1, tuple(sorted(days.items()))
        self.spark.range(1).select(
            F.lit(version).cast("long").alias("version"), F.lit(json.dumps(listed)).alias("body")
        ).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return DayTable(self.spark, self.path, self.schema, self.key, self.time, version, listed)


@dataclass(frozen=True)
class Retained:
    jobs: DayTable
    children: tuple[StoredTable, ...]
    deleted: int


def retain(jobs: DayTable, children: Sequence[StoredTable], as_of: datetime | str, max_age_seconds: int) -> Retained:
    """Deletes old postings and, in stored tables keyed by posting, what hangs on them.

    Children meet the deleted keys in their own buckets; buckets without such a key are not read. Should
    the job end between the postings and a child, a second run finds no old postings: call
    :func:`drop_orphans` then.
    """
    table, old, count = jobs.delete_older(as_of, max_age_seconds)
    if not count:
        return Retained(table, tuple(children), 0)
    return Retained(table, tuple(child.delete(old) for child in children), count)


def drop_orphans(jobs: DayTable, child: StoredTable) -> StoredTable:
    """Deletes child rows whose posting is not there."""
    return child.delete(child.read().select(child.key).join(jobs.read().select(jobs.key), jobs.key, "left_anti"))
