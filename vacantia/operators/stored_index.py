"""An inverted index in files: searched as stored, followed by segments.

    <path>/manifest                 a JSON row per version: the live segments and the layout
    <path>/postings/segment=<s>/token_bucket=<b>    files bucketed by key, one per slice of keys
    <path>/keys/segment=<s>         every key the segment speaks for, also keys without any text

A change appends one segment with the new entries of the touched postings. An older segment's
entries of these postings are void from then on; nothing is rewritten. A reader takes the newest
manifest and keeps, per key, the entries of the newest segment that speaks for it. ``compact`` folds
segments into a new one, slice by slice of keys. Files of segments that no manifest names are never read.

One writer at a time; readers need no lock, as a manifest names its segments once and for all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.operators import keywords
from vacantia.operators.keywords import Condition, field_texts
from vacantia.operators.text_index import build_index

#: A token lies in the bucket of its first letters, so that a beginning of as many letters has one bucket.
STEM = 3
#: Bytes of text whose entries one task builds and puts in order.
SLICE = 32 << 20
#: Bytes a posting counts for whose size no segment tells.
UNKNOWN_SIZE = 4096
SEGMENT, TOKEN_BUCKET = "segment", "token_bucket"
_POSTING_TYPE = "token string, field string, {key} string, positions array<int>, segment long, token_bucket int"


def token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, STEM)), F.lit(buckets)).cast("int")


def key_slice(key: str, slices: int) -> Column:
    """The slice of a posting: the bucket that ``bucketBy`` gives to its key."""
    return F.pmod(F.hash(F.col(key).cast("string")), F.lit(slices))


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[int, ...]
    buckets: int
    files_per_bucket: int
    key: str
    fields: tuple[str, ...]
    #: Per segment the number of slices its files are bucketed in by key; 0 where they are not.
    slices: tuple[int, ...] = ()


@dataclass(frozen=True)
class StoredIndex:
    """The index as one manifest describes it. Changes return the index of the next manifest."""

    spark: SparkSession
    path: str
    manifest: Manifest

    @staticmethod
    def create(
        jobs: DataFrame, path: str, buckets: int = 64, files_per_bucket: int = 8, key: str = "job_id",
        fields: Sequence[str] = C.INDEXED_FIELDS,
    ) -> StoredIndex:
        """Index all postings as segment 0.

        Texts are dealt out to tasks by key in slices of at most ``SLICE`` bytes or so, and each task writes a
        file per bucket, so no task gets a word that stands in every posting whole. ``files_per_bucket`` is
        the least number of slices where :meth:`compact` deals the entries out anew.
        """
        start = Manifest(0, (), buckets, files_per_bucket, key, tuple(fields))
        return StoredIndex(jobs.sparkSession, path, start)._appended(jobs, None)

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredIndex:
        """The newest state."""
        row = spark.read.schema("version long, body string").json(f"{path}/manifest").orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no index at {path}")
        body = json.loads(row["body"])
        manifest = Manifest(row["version"], tuple(body["segments"]), body["buckets"], body["files_per_bucket"],
                            body["key"], tuple(body["fields"]),
                            tuple(body.get("slices", [0] * len(body["segments"]))))
        return StoredIndex(spark, path, manifest)

    # --- changes ----------------------------------------------------------------------------------

    def upsert(self, touched: DataFrame) -> StoredIndex:
        """One segment with the entries of new and replaced postings; ``touched`` has one row per key."""
        return self._appended(touched, None)

    def delete(self, removed: DataFrame) -> StoredIndex:
        """One segment that holds the removed keys and no entries."""
        return self._appended(None, removed)

    def _appended(self, touched: DataFrame | None, removed: DataFrame | None) -> StoredIndex:
        m = self.manifest
        segment, slices = self._next_segment(), 0
        if touched is not None:
            dealt, slices = self._dealt(touched)
            entries = build_index(dealt, m.key, m.fields, group=lambda token: token_bucket(token, m.buckets))
            self._write(entries, segment, slices)
        rows, size = (touched, self._size(touched)) if removed is None else (removed, F.lit(0).cast("long"))
        keys = rows.select(F.col(m.key).cast("string").alias(m.key), size.alias("text_bytes"))
        self._write_keys(keys.withColumn("live", F.lit(removed is None)), segment)
        return self._committed((*m.segments, segment), (*m.slices, slices))

    def compact(self, upto: int | None = None) -> StoredIndex:
        """Folds the segments up to ``upto`` (all, by default) into a new one; later ones stay.

        The folded segment keeps the place of the first, so later segments still overrule it. It has the slices
        of the most finely sliced segment. Entries of segments with as many slices are neither shuffled nor
        held: each slice is read, met with its later keys and written by one task. Entries of other segments,
        which are the smaller ones, are dealt out to these slices. Only where the postings have outgrown
        the slices twice over are all entries dealt out anew.
        """
        m = self.manifest
        sliced = dict(zip(m.segments, m.slices))
        folded = tuple(s for s in m.segments if upto is None or s <= upto)
        rest = tuple(s for s in m.segments if s not in folded)
        view = replace(self, manifest=replace(m, segments=folded, slices=tuple(sliced[s] for s in folded)))
        segment = self._next_segment()
        keys = view._live()
        total = keys.agg(F.sum(F.coalesce("text_bytes", F.lit(UNKNOWN_SIZE)))).first()[0] or 0
        slices, needed = max(view.manifest.slices, default=0), self._slices(total, SLICE)
        if needed > 2 * slices:
            slices = max(needed, m.files_per_bucket)
        with view._as_tables(slices) as tables:
            kept = [view._kept(place, tables.get(s), slices) for place, s in enumerate(folded)]
            self._write(reduce(DataFrame.union, kept), segment, slices)
        self._write_keys(keys.withColumn("live", F.lit(True)), segment)
        return self._committed((segment, *rest), (slices, *[sliced[s] for s in rest]))

    def _write_keys(self, keys: DataFrame, segment: int) -> None:
        keys.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/keys/{SEGMENT}={segment}")

    def _next_segment(self) -> int:
        """A number that no manifest has named; what a failed change left under it is overwritten."""
        if not self.manifest.segments and not self.manifest.version:
            return 0
        rows = self.spark.read.schema("version long, body string").json(f"{self.path}/manifest").collect()
        return 1 + max((s for r in rows for s in json.loads(r["body"])["segments"]), default=-1)

    def _size(self, jobs: DataFrame) -> Column:
        """Bytes of text of a posting."""
        texts = field_texts(jobs, self.manifest.fields).values()
        return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts])

    def _slices(self, total: int, width: int) -> int:
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        return min(most, max(1, -(-total // width)))

    def _dealt(self, jobs: DataFrame) -> tuple[DataFrame, int]:
        """The texts in slices of bounded size, whose entries a task can put in order in memory.

        Entries take several times the room of their texts, so the texts are dealt out and not the entries.
        """
        m = self.manifest
        total = jobs.agg(F.sum(self._size(jobs))).first()[0] or 0
        width = min(SLICE, max(SLICE // 8, -(-total // self.spark.sparkContext.defaultParallelism)))
        slices = self._slices(total, width)
        return jobs.select(m.key, *m.fields).repartitionById(slices, key_slice(m.key, slices)), slices

    def _write(self, entries: DataFrame, segment: int, slices: int) -> None:
        """Files by bucket, in order by token, and by slice of keys; a table is what Spark writes buckets for."""
        m = self.manifest
        name = _table_name()
        try:
            (
                entries.select("token", "field", F.col(m.key).cast("string").alias(m.key), "positions")
                .withColumn(TOKEN_BUCKET, token_bucket(F.col("token"), m.buckets))
                .write.format("parquet").mode("overwrite").option("partitionOverwriteMode", "static")
                .partitionBy(TOKEN_BUCKET).bucketBy(slices, m.key).sortBy("token")
                .option("path", self._postings_of(segment)).saveAsTable(name)
            )
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _postings_of(self, segment: int) -> str:
        """The whole path: a table takes a relative one to lie in the warehouse."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings/{SEGMENT}={segment}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def _committed(self, segments: tuple[int, ...], slices: tuple[int, ...]) -> StoredIndex:
        m = self.manifest
        version = m.version + 1
        body = json.dumps({"segments": segments, "buckets": m.buckets, "files_per_bucket": m.files_per_bucket,
                           "key": m.key, "fields": m.fields, "slices": slices})
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(body).alias("body"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return StoredIndex(self.spark, self.path, replace(m, version=version, segments=segments, slices=slices))

    # --- reading ----------------------------------------------------------------------------------

    def _order(self) -> Column:
        """The place of a row's segment in the manifest; a folded segment stands before later ones."""
        places = F.create_map(*[F.lit(x) for i, s in enumerate(self.manifest.segments) for x in (int(s), i)])
        return F.element_at(places, F.col(SEGMENT))

    def _key_rows(self) -> DataFrame:
        schema = f"`{self.manifest.key}` string, text_bytes long, live boolean, {SEGMENT} long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/keys")

    def _spoken_for(self) -> DataFrame:
        """Keys of all segments but the first, with the place of the newest segment and whether it kept them."""
        m = self.manifest
        later = self._key_rows().filter(F.col(SEGMENT).isin([int(s) for s in m.segments[1:]]))
        last = F.max(F.struct(self._order().alias("newest"), "live", "text_bytes")).alias("_s")
        return later.groupBy(m.key).agg(last).select(m.key, "_s.*")

    @contextmanager
    def _as_tables(self, slices: int) -> Iterator[dict[int, DataFrame]]:
        """The entries of each segment with so many slices, as a table that Spark knows to be bucketed by key."""
        m = self.manifest
        names = {s: _table_name() for s, n in zip(m.segments, m.slices) if n == slices}
        columns = _POSTING_TYPE.format(key=f"`{m.key}`").replace(", segment long", "")
        try:
            for s, name in names.items():
                place = self._postings_of(s).replace("\\", "\\\\").replace("'", "\\'")
                self.spark.sql(
                    f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({TOKEN_BUCKET}) "
                    f"CLUSTERED BY (`{m.key}`) INTO {slices} BUCKETS LOCATION '{place}'")
                self.spark.catalog.recoverPartitions(name)
            yield {s: self.spark.table(name) for s, name in names.items()}
        finally:
            for name in names.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _kept(self, place: int, table: DataFrame | None, slices: int) -> DataFrame:
        """The entries of one segment that no later one speaks for, in slices.

        A hash join with the keys leaves the entries of a bucketed table where they are; a sort merge join would
        not, unless they were sorted by key, and a broadcast would hold all keys everywhere.
        """
        m = self.manifest
        rows = table
        if table is None:
            rows = self.spark.read.schema(_POSTING_TYPE.format(key=m.key)).parquet(f"{self.path}/postings")
            rows = rows.filter(F.col(SEGMENT) == int(m.segments[place]))
        rows = rows.select("token", "field", m.key, "positions")
        if later := [int(s) for s in m.segments[place + 1:]]:
            newer = self._key_rows().filter(F.col(SEGMENT).isin(later)).select(m.key)
            rows = rows.join(newer.hint("shuffle_hash"), m.key, "left_anti").select(*rows.columns)
        return rows if table is not None else rows.repartitionById(slices, key_slice(m.key, slices))

    def postings(self, condition: Condition | None = None) -> DataFrame:
        """Valid entries ``(token, field, key, positions)``, all or those a condition asks for.

        The buckets of the asked words are constants, so only their folders are listed and read; inside a
        file, entries are sorted by token and the words are pushed to the scan. A beginning of fewer than
        three letters may lie in any bucket and is looked up in all. The keys of later segments are met in
        an anti join; the first segment's keys, the large table, are not read.
        """
        m = self.manifest
        rows = self.spark.read.schema(_POSTING_TYPE.format(key=m.key)).parquet(f"{self.path}/postings")
        rows = rows.filter(F.col(SEGMENT).isin([int(s) for s in m.segments]))
        if condition is not None:
            condition.check_fields(m.fields)
            stems = condition.stems()
            if all(len(s) >= STEM for s in stems):
                asked = sorted({w[:STEM] for w in [*condition.exact_words(), *stems]})
                rows = rows.filter(F.col(TOKEN_BUCKET).isin([token_bucket(F.lit(w), m.buckets) for w in asked]))
            rows = rows.filter(condition.asks_for(F.col("token")))
        if len(m.segments) > 1:
            newer = self._spoken_for().select(F.col(m.key).alias("_key"), "newest")
            void = (F.col(m.key) == F.col("_key")) & (F.col("_place") < F.col("newest"))
            rows = rows.withColumn("_place", self._order()).join(newer, void, "left_anti")
        return rows.select("token", "field", m.key, "positions")

    def keys(self) -> DataFrame:
        """Keys of all indexed postings."""
        return self._live().select(self.manifest.key)

    def _live(self) -> DataFrame:
        """Keys of all indexed postings and the bytes of their texts."""
        m = self.manifest
        first = self._key_rows().filter((F.col(SEGMENT) == int(m.segments[0])) & F.col("live")).select(m.key, "text_bytes")
        if len(m.segments) == 1:
            return first
        later = self._spoken_for()
        return first.join(later, m.key, "left_anti").union(later.filter("live").select(m.key, "text_bytes"))

    def search(self, condition: Condition | str) -> DataFrame:
        """Keys of the postings a condition, or a line of :func:`keywords.from_text`, holds for."""
        if isinstance(condition, str):
            condition = keywords.from_text(condition, self.manifest.fields)
        everything = self.keys() if condition.holds_without_tokens() else None
        return keywords.search_index(self.postings(condition), condition, self.manifest.key, everything)


def _table_name() -> str:
    return f"vacantia_index_{uuid.uuid4().hex}"
