"""Change detection with the last row of every key held in the state store."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacantia import constants as C

#: Value state lives in this store; set it on the session before the stream starts.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def _edits(rows: list[tuple], fields: Sequence[str], held: tuple | None) -> Iterator[tuple]:
    """(time, field, old, new) of consecutive rows ``(order..., values)``, after the held values."""
    for order, values in rows:
        if held is not None:
            for name, old, new in zip(fields, held, values):
                if old != new:
                    yield order[0], name, old, new
        held = values


class _LastRow(StatefulProcessor):
    """Per key one tuple of tracked values: those of the row that arrived last."""

    def __init__(self, key: str, order: list[str], fields: list[str]):
        self.key, self.order, self.fields = key, order, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField(f"v{i}", T.StringType()) for i in range(len(self.fields))])
        self.last = handle.getValueState("last", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.last.get()) if self.last.exists() else None
        arrived = []
        for part in rows:
            orders = zip(*[part[c] for c in self.order])
            values = zip(*[part[c].astype(object).where(part[c].notna(), None) for c in self.fields])
            arrived += zip(orders, values)
        arrived.sort(key=lambda row: row[0])
        found = [(key[0], *edit) for edit in _edits(arrived, self.fields, held)]
        if arrived:
            self.last.update(arrived[-1][1])
        if found:
            yield pd.DataFrame(found, columns=[self.key, "changed_at", "field_name", "old_value", "new_value"])

    def close(self) -> None:
        pass


def detect_changes(
    snapshots: DataFrame, key: str = "job_id", time: str = "scraped_at",
    fields: Sequence[str] = C.TRACKED_FIELDS, tie_break: Sequence[str] = (),
) -> DataFrame:
    """Stream of snapshots → stream of edits of tracked fields.

    The state of a key is the tracked values of its last row, whatever the length of its history, and
    lives in the checkpoint, so a restarted stream goes on where it stopped. Inside a micro-batch a key's
    rows are put in order of time; between micro-batches arrival decides: a late file is compared
    with what was stored before it. With files in order of time the edits are those of
    :func:`vacantia.operators.changes.change_log` over all of them. Rows without a key or a time are left
    out. Only key, order and tracked values are shuffled; a task holds the rows that one micro-batch has for
    one key, in this narrow form, so bound the micro-batch (files or bytes per trigger) where a key may
    own a large share of it. Needs the store named in ``STATE_STORE``.
    """
    kind = snapshots.schema[key].dataType.simpleString()
    clock = snapshots.schema[time].dataType.simpleString()
    order = [time, *tie_break]
    narrow = snapshots.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        key, *dict.fromkeys(order), *[F.col(f).cast("string").alias(f) for f in fields if f not in order])
    return narrow.groupBy(key).transformWithStateInPandas(
        _LastRow(key, order, list(fields)),
        f"{key} {kind}, changed_at {clock}, field_name string, old_value string, new_value string",
        "append", "None",
    )


@contextmanager
def stateful_session(spark: SparkSession, partitions: int | None = None):
    """Settings under which a stateful stream has to be started; they stay with the stream.

    ``partitions`` is the number of state stores, fixed for the life of the checkpoint; by default that
    of ``spark.sql.shuffle.partitions``.
    """
    wanted = dict([STATE_STORE])
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield spark
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# Shipped by value, so that workers need no package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
