"""A keyed table in files that a stream of batches keeps current.

    <path>/data/version=<v>/bucket=<b>   the rows of a bucket as version v left them
    <path>/changes/version=<v>           the edits version v made
    <path>/manifest                      a JSON row per version: batch, and the version of each bucket

A batch reads and rewrites the buckets of its keys and no others. Its files are written beside the
current ones and count only once the manifest names them, so a reader always sees one whole version,
a failed batch leaves no trace, and a batch that comes again is known by its number. One writer.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators.changes import change_log
from vacantia.operators.latest import latest_by_key
from vacantia.operators.merge import BUCKET, bucket_of

VERSION = "version"
_MANIFEST = "version long, batch long, body string"


@dataclass(frozen=True)
class StoredTable:
    """Layout and state. ``versions`` maps each non-empty bucket to the version that wrote it."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int
    files_per_bucket: int = 4
    version: int = 0
    batch: int | None = None
    versions: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def open(
        spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64, files_per_bucket: int = 4,
    ) -> StoredTable:
        """The newest version, or an empty table; ``buckets`` counts for a new table only."""
        empty = StoredTable(spark, path, schema, key, buckets, files_per_bucket)
        if not path_exists(spark, f"{path}/manifest"):
            return empty
        row = spark.read.schema(_MANIFEST).json(f"{path}/manifest").orderBy(F.desc(VERSION)).first()
        body = json.loads(row["body"])
        versions = tuple((int(b), v) for b, v in body["versions"])
        return StoredTable(spark, path, schema, body["key"], body["buckets"], files_per_bucket, row[VERSION], row["batch"], versions)

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """Current rows, of all buckets or some. Every bucket is one folder, so none else is listed."""
        wanted = [(b, v) for b, v in self.versions if only is None or b in set(only)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def keys_of(self, keys: Sequence) -> DataFrame:
        """Current rows of a few keys: their buckets only."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        touched = [r[0] for r in asked.select(bucket_of(self.key, self.buckets)).distinct().collect()]
        return self.read(touched).filter(F.col(self.key).isin(list(keys)))

    def changes(self) -> DataFrame:
        """Edits of all versions so far; a folder that no manifest names is not read."""
        if not self.version:
            return self.spark.createDataFrame([], _change_type(self.schema, self.key, "timestamp_ntz"))
        log = self.spark.read.parquet(f"{self.path}/changes")
        return log.filter(F.col(VERSION) <= self.version).drop(VERSION)

    def upsert(
        self, batch: DataFrame, batch_id: int, order: str | Sequence[str], tracked: Sequence[str] = (),
        time: str | None = None,
    ) -> StoredTable:
        """The table after a batch: the last row per key replaces the stored one.

        ``order`` ranks the rows of one key inside the batch. With ``tracked`` fields, their edits are kept
        as well: between the stored row and the batch, and between rows of the batch; ``time`` (by
        default the first of ``order``) dates them. Batches come with rising numbers; a number that is
        not above the last one has been done and changes nothing. Rows without a key are left out.

        Bucket numbers, at most ``buckets``, come to the driver. Of the stored rows only the touched
        buckets are read; the batch is shuffled by key, with one row per key and task after the first
        reduction, so a key that owns a third of it is no hot task.
        """
        if self.batch is not None and batch_id <= self.batch:
            return self
        orders = [order] if isinstance(order, str) else list(order)
        rows = batch.filter(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in rows.select(bucket_of(self.key, self.buckets)).distinct().collect())
        version = self.version + 1
        columns = [f.name for f in self.schema.fields]
        fresh = latest_by_key(rows, self.key, orders).select(*columns)
        stored = self.read(touched)
        kept = stored.join(fresh.select(self.key), self.key, "left_anti")
        self._write(kept.unionByName(fresh), version)
        self._write_changes(stored, rows, orders, tracked, time or orders[0], version)
        return self._committed({**dict(self.versions), **{b: version for b in touched}}, batch_id)

    def delete(self, keys: DataFrame) -> StoredTable:
        """The table without these keys; buckets that hold none of them are neither read nor written."""
        gone = keys.select(F.col(self.key))
        asked = {r[0] for r in gone.select(bucket_of(self.key, self.buckets)).distinct().collect()}
        touched = sorted(asked & set(dict(self.versions)))
        if not touched:
            return self
        version = self.version + 1
        self._write(self.read(touched).join(gone, self.key, "left_anti"), version)
        target = f"{self.path}/data/{VERSION}={version}"
        layout = T.StructType([T.StructField(BUCKET, T.IntegerType())])
        left = {r[0] for r in self.spark.read.schema(layout).parquet(target).distinct().collect()}
        untouched = {b: v for b, v in self.versions if b not in touched}
        return self._committed({**untouched, **{b: version for b in left}}, self.batch)

    def _write(self, rows: DataFrame, version: int) -> None:
        spread = F.pmod(F.xxhash64(F.lit("file"), F.col(self.key)), F.lit(self.files_per_bucket))
        (
            rows.withColumn(BUCKET, bucket_of(self.key, self.buckets))
            .repartition(F.col(BUCKET), spread).sortWithinPartitions(BUCKET, self.key)
            .write.mode("overwrite").option("partitionOverwriteMode", "static")
            .partitionBy(BUCKET).parquet(f"{self.path}/data/{VERSION}={version}")
        )

    def _committed(self, versions: dict[int, int], batch: int | None) -> StoredTable:
        version, listed = self.version + 1, tuple(sorted(versions.items()))
        body = json.dumps({"key": self.key, "buckets": self.buckets, "versions": listed})
        self.spark.range(1).select(
            F.lit(version).cast("long").alias(VERSION), F.lit(batch).cast("long").alias("batch"), F.lit(body).alias("body")
        ).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return StoredTable(self.spark, self.path, self.schema, self.key, self.buckets, self.files_per_bucket, version, batch, listed)

    def _write_changes(self, stored, rows, orders, tracked, time, version) -> None:
        if not tracked:
            return
        narrow = list(dict.fromkeys([self.key, *orders, time, *tracked]))
        fresh = rows.select(*narrow)
        # Arrival decides: the stored row goes before the batch whatever its own time says.
        missing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in narrow if c not in stored.columns}
        before = stored.join(fresh.select(self.key).distinct(), self.key, "left_semi").withColumns(missing).select(*narrow)
        first = F.lit("0001-01-01").cast(rows.schema[time].dataType)
        edits = change_log(fresh.unionByName(before.withColumn(time, first)), self.key, time, tracked, [o for o in orders if o != time])
        edits.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.path}/changes/{VERSION}={version}")

    def obsolete(self) -> list[str]:
        """Folders of bucket versions that no reader of the newest version opens."""
        live = set(self.versions)
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").collect()
        seen = {(int(b), v) for r in rows for b, v in json.loads(r["body"])["versions"]}
        return sorted(f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in seen - live)


def _change_type(schema: T.StructType, key: str, clock: str) -> str:
    kind = schema[key].dataType.simpleString()
    return f"{key} {kind}, changed_at {clock}, field_name string, old_value string, new_value string"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
