"""Split points from a sample that tasks draw by themselves and that is merged, without a sort of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample, which is all that the driver gets.
SAMPLE = 4096


def _least(size: int):
    """The size rows of a task with the least first column, whatever the task reads."""

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows > size:
            t = t.take(np.argpartition(t.column(0).to_numpy(), size)[:size])
        return t.combine_chunks().to_batches()[0] if t.num_rows else held[0]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, None
        for b in batches:
            if most is not None:  # no more than what is held already has
                b = b.filter(pa.array(b.column(0).to_numpy() < most))
            held.append(b)
            n += b.num_rows
            if n >= 4 * size:
                held = [cut(held)]
                n, most = held[0].num_rows, int(held[0].column(0).to_numpy().max())
        if n:
            yield cut(held)

    return f


def least_hashes(rows: DataFrame, size: int = SAMPLE, hashed: Column | None = None) -> DataFrame:
    """A uniform sample of rows: the size rows with the least 64-bit hash (hashed, or of the row and its place).

    Each task keeps its least ones; those of up to 1024 tasks are merged in one, and these in the last. So there is one scan, no
    sort and no row that is not among a task's least in the shuffle. Any two such samples merge to the one of both inputs."""
    h = F.xxhash64(*rows.columns, F.monotonically_increasing_id()) if hashed is None else hashed
    own = rows.select(h.cast("bigint").alias("__h"), *rows.columns)
    some = own.mapInArrow(_least(size), own.schema).withColumn("__lane", F.shiftright(F.spark_partition_id(), 10))
    some = some.repartition("__lane").drop("__lane").mapInArrow(_least(size), own.schema)
    return some.orderBy("__h").limit(size).drop("__h")


def approximate_split_points(lines: DataFrame, n: int, column: str = "line", size: int = SAMPLE, hashed: Column | None = None) -> list[str]:
    """n - 1 points (fewer of fewer rows) that cut column into n ranges of about equal numbers of rows.

    The sibling of operators.split_points, which sorts all rows, for inputs of which that is too much: the points are those of a
    sample of size rows, which the driver sorts. With probability 1 - d no point is further from its place than
    sqrt(ln(2 / d) / (2 size)) of all rows, 4 % for the default size and d = 1e-6, whatever their number; repeated
    values count as often as they are there."""
    if n < 1:
        raise ValueError("the number of partitions must be at least 1")
    values = sorted((r[0] for r in least_hashes(lines.select(column).filter(F.col(column).isNotNull()), size, hashed).collect()), key=str.encode)
    return values if len(values) < n else [values[i * len(values) // n] for i in range(1, n)]
