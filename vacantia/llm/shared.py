"""Helpers of the corpus operators: written tables, ranks inside hot groups, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none (tests, notebooks), a folder of the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/corpus/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a re-read of a few files, and lets later steps
    prune columns. The folder is scratch space: clear it when the application has ended.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them in any case."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def rank_in_group(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the row's 0-based rank inside its group, for groups of any size.

    Rows are range-partitioned by group *and* order, so a group that holds a third of the table
    spans many tasks. Ranks inside a task are shifted by the group's counts in earlier tasks; only
    these counts, one row per task and group, meet in a window. The result is written once. A column
    of the new name is replaced.
    """
    df = df.drop(name)
    task, place, start, size, shift = fresh(df.columns, "__task", "__place", "__first", "__rows", "__shift")
    sorted_rows = written(
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group + order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in group + order])
        .withColumns({
            task: F.spark_partition_id(),
            place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }),
        "ranked",
    )
    counts = sorted_rows.groupBy(*group, task).agg(
        F.min(place).alias(start), F.count(F.lit(1)).alias(size)
    )
    earlier = F.sum(size).over(_window(group, task))
    starts = counts.select(
        *group, task, (F.coalesce(earlier, F.lit(0)) - F.col(start)).alias(shift)
    )
    same = F.col(f"r.{task}") == F.col(f"s.{task}")
    for column in group:
        same &= F.col(f"r.`{column}`").eqNullSafe(F.col(f"s.`{column}`"))
    return sorted_rows.alias("r").join(starts.alias("s"), same).select(
        *[F.col(f"r.`{c}`") for c in df.columns],
        (F.col(f"r.{place}") + F.col(f"s.{shift}")).cast("long").alias(name),
    )


def _window(group: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges ``(a, b)``: one row ``(node, component)`` per node with an edge.

    The component is the smallest node. Large-star and small-star steps alternate: every step is a
    minimum per node, combined before the shuffle, and a join back, which the adaptive planner can
    split at a hub. Each round is written to the shared folder; two numbers come to the driver.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a") != F.col("b")).distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct()
        )
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")),
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            )).alias("e")).select("e.a", "e.b")
            .filter(F.col("a") != F.col("b")).distinct()
        )
        links = written(small, "small-star")
        now = links.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )


def map_groups(df: DataFrame, keys: list[str], solve, schema: str) -> DataFrame:
    """Calls ``solve(columns)`` for every group and returns the rows it gives, as tuples.

    For very many small groups: rows are shuffled and sorted by the keys and streamed, and a task
    holds one Arrow batch and one unfinished group. ``columns`` maps names to arrays of the group's
    values. Groups must be bounded by the caller.
    """
    import numpy as np
    import pandas as pd

    names = [part.split()[0] for part in schema.split(",")]

    def stream(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                held, done = _cut(held)
                yield from solved(done)
        if held is not None and len(held):
            yield from solved(held)

    def _starts(frame):
        new = np.zeros(len(frame), dtype=bool)
        new[0] = True
        for key in keys:
            values = frame[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def _cut(frame):
        last = int(_starts(frame)[-1])
        return frame.iloc[last:].reset_index(drop=True), frame.iloc[:last]

    def solved(frame):
        if not len(frame):
            return
        arrays = {c: frame[c].to_numpy() for c in frame.columns}
        starts = _starts(frame)
        rows = []
        for low, high in zip(starts, np.r_[starts[1:], len(frame)]):
            rows.extend(solve({c: v[low:high] for c, v in arrays.items()}))
            if len(rows) >= 20_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    def _frame(rows):
        columns = list(zip(*rows))
        return pd.DataFrame({
            n: pd.array(c, dtype="Int64") if None in c else list(c) for n, c in zip(names, columns)
        })

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def map_served(df: DataFrame, keys: list[str], guest: str, host, serve, schema: str) -> DataFrame:
    """Lets the guests of a group, any number, stream past its hosts, a bounded number.

    Rows where ``guest`` is false are the hosts: they are held as ``state = host(columns)``, made once a
    group. The guests follow in slices, ``serve(state, columns)`` gives rows as tuples. A group
    without hosts serves nobody. The caller bounds the hosts of a group; guests are never held.
    """
    import numpy as np
    import pandas as pd

    names = [part.split()[0] for part in schema.split(",")]

    def stream(batches):
        key, held, state = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), dtype=bool)
            new[0] = True
            for column in [*keys, guest]:
                values = batch[column].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(new)
            for low, high in zip(starts, np.r_[starts[1:], len(batch)]):
                part = batch.iloc[low:high]
                own = tuple(part[c].iloc[0] for c in keys)
                if own != key:
                    key, held, state = own, [], None
                if not part[guest].iloc[0]:
                    held.append(part)
                    continue
                if held:
                    together = pd.concat(held, ignore_index=True)
                    state, held = host({c: together[c].to_numpy() for c in together.columns}), []
                if state is not None:
                    rows = serve(state, {c: part[c].to_numpy() for c in part.columns})
                    if rows:
                        yield pd.DataFrame(dict(zip(names, map(list, zip(*rows)))))

    return df.repartition(*keys).sortWithinPartitions(*keys, guest).mapInPandas(stream, schema)
