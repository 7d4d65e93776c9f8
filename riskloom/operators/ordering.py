"""Ordered work that stays distributed: cut-off filters and running totals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from riskloom.session import ranges
from riskloom.sources.sinks import materialize


#: Rows up to which the cut-off is looked up by one bounded sort, and rows of a sample that guesses it in a larger table.
SORTED_ROWS, SAMPLED_ROWS = 200_000, 10_000
Order = Sequence[tuple[str, bool]]


def _columns(order: Order) -> list[Column]:
    return [F.desc(name) if down else F.asc(name) for name, down in order]


def not_after(order: Order, row: Row) -> Column:
    """Whether a row's keys come no later in ``order`` than those of ``row``."""
    test = F.lit(True)
    for name, down in reversed(order):
        key, edge = F.col(name), F.lit(row[name])
        test = (key > edge if down else key < edge) | ((key == edge) & test)
    return F.coalesce(test, F.lit(False))


def cutoff(df: DataFrame, order: Order, k: int, parts: int | None = None, sorted_rows: int = SORTED_ROWS, sampled_rows: int = SAMPLED_ROWS) -> DataFrame:
    """One row holding the keys of the ``k``-th row in ``order`` (name, descending); no row when there are fewer. Keys are never null.

    A sample guesses a key that a little more than ``k`` rows do not come after. One pass counts these rows exactly, and if they
    are enough only they are range-partitioned and ranked; so what is shuffled grows with ``k``, not with the table. A guess that
    fell short costs a pass; then all rows are ranked.
    """
    keys = [name for name, _ in order]
    narrow, rows = df.select(*keys), df.count()
    struct = F.struct(*keys).alias("cut")
    if rows < k:
        return narrow.limit(0).select(struct)
    if rows <= sorted_rows:
        return narrow.orderBy(*_columns(order)).offset(k - 1).limit(1).select(struct)
    share = min(1.0, sampled_rows / rows)
    rank = int(k * share + 4 * (k * share) ** 0.5 + 10)
    if rank < 0.9 * sampled_rows:
        guess = narrow.sample(share, 17).orderBy(*_columns(order)).offset(rank).limit(1).collect()
        if guess:
            near = narrow.filter(not_after(order, guess[0]))
            if near.count() >= k:
                narrow = near
    parts = parts or ranges(narrow)
    placed = materialize(narrow.repartitionByRange(parts, *_columns(order)).withColumn("_part", F.spark_partition_id()))
    until = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range: at most ``parts`` rows, so the window and the broadcast are bounded.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_until", F.sum("_n").over(until))
    at = counts.filter((F.col("_until") >= k) & (F.col("_until") - F.col("_n") < k))
    inside = placed.join(F.broadcast(at.select("_part", (k - F.col("_until") + F.col("_n")).alias("_k"))), "_part")
    ranked = inside.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*_columns(order))))
    return ranked.filter("_rn = _k").select(struct)


def _placed(df: DataFrame, order: Sequence[str], parts: int | None) -> DataFrame:
    """Rows sorted in range partitions. Rows of equal keys are told apart by where they were read, so any number of them spreads."""
    read = df.withColumn("_read", F.monotonically_increasing_id())
    ranged = read.repartitionByRange(parts or ranges(df), *order, "_read").sortWithinPartitions(*order, "_read")
    return ranged.drop("_read").withColumn("_part", F.spark_partition_id())


def _offsets(written: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What the partitions before each one add up to: one row a partition, read back from what the tasks wrote."""
    total = written.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(total.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]))


def numbered(df: DataFrame, order: Sequence[str], name: str = "_n", parts: int | None = None) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in global ``order``, rows of equal keys in any order; one exchange and no Python.

    A row's place in its partition is taken where it is written; reading back only adds the partition's offset.
    """
    local = materialize(_placed(df, order, parts).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    return local.join(_offsets(local, {"_rows": F.count("*")}), "_part").select(*df.columns, (F.col("_place") + F.col("_before__rows")).alias(name))


def running_totals(df: DataFrame, order: Sequence[str], flags: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Add inclusive running sums of ``flags`` in global ``order`` without a single-task window.

    Rows are range-partitioned once. The tasks that sort them add up along the way and write the sums as far as they know them;
    reading back adds the offset of each partition, one row of which a partition is enough to know.
    """
    names = list(flags)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(names)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k, name in enumerate(names):
                total = np.cumsum(columns[name].to_numpy()) + carried[k]
                carried[k] = int(total[-1]) if len(total) else carried[k]
                columns[name] = pa.array(total, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    kept = [c for c in df.columns if c not in names]
    flagged = df.select(*kept, *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in flags.items()])
    placed = _placed(flagged, order, parts)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    local = materialize(placed.mapInArrow(along, fields))
    joined = local.join(_offsets(local, {n: F.max(n) for n in names}), "_part")
    return joined.select(*kept, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])
