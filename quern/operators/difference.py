"""Whether two results are the same, and whether written parts are in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def difference(got: DataFrame, want: DataFrame, name: str = "surplus") -> DataFrame:
    """Rows that got and want do not have equally often, and how much more often got has them: under 0, they are missing
    in got. No rows: the two are the same multiset. Columns are matched by name, and nulls are equal to nulls.

    Each side's rows count 1 and -1, and are summed in the task before they are shuffled, so a row that is there very often
    is a row for each task."""
    if set(got.columns) != set(want.columns):
        raise ValueError(f"columns differ: {sorted(got.columns)} and {sorted(want.columns)}")
    if name.lower() in {c.lower() for c in got.columns}:
        raise ValueError(f"column {name} exists already")
    signed = got.withColumn(name, F.lit(1)).unionByName(want.withColumn(name, F.lit(-1)))
    return signed.groupBy(*got.columns).agg(F.sum(name).alias(name)).filter(F.col(name) != 0)


_RUN = "file string, at long, n long, breaks long, first_key string, first_line string, last_key string, last_line string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lines of each stretch of a file that a task reads: their number, how often one is less than that
    before, the first and the last."""
    run: list = []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, run, strict=True))], kinds)

    names = [x.split()[0] for x in _RUN.split(", ")]
    kinds = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _RUN.split(", ")])
    for b in batches:
        if not b.num_rows:
            continue
        file, at, key, line = b.columns
        first, then = (lambda c: c.slice(0, b.num_rows - 1)), (lambda c: c.slice(1))
        other = pc.or_(pc.not_equal(then(file), first(file)), pc.not_equal(then(at), first(at)))
        less = pc.or_(pc.less(then(key), first(key)), pc.and_(pc.equal(then(key), first(key)), pc.less(then(line), first(line))))
        begin = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        down = np.append(False, less.to_numpy(zero_copy_only=False))
        for i, j in zip(begin, begin[1:], strict=False):
            cells = [file[i].as_py(), at[i].as_py(), key[i].as_py(), line[i].as_py(), key[j - 1].as_py(), line[j - 1].as_py()]
            breaks = int(down[i + 1 : j].sum())
            if run and run[:2] == cells[:2]:
                # A stretch that goes on in this batch; UTF-8 is compared by bytes.
                breaks += tuple(map(str.encode, cells[2:4])) < tuple(map(str.encode, run[6:]))
                run = [*run[:2], run[2] + j - i, run[3] + breaks, *run[4:6], *cells[4:]]
            else:
                if run:
                    yield told()
                run = [*cells[:2], j - i, breaks, *cells[2:]]
    if run:
        yield told()


def order_breaks(spark: SparkSession, path: str, key: Column | None = None) -> DataFrame:
    """(file, n, breaks) of each text file of path with lines: how many it has, and how often a line is less than that
    before it, in the file or, for its first line, at the end of the files before it by name. Lines are ordered by key (of the column
    value; the whole line unless told) and then by line, bytewise. All breaks 0: the files, by name, are in order.

    Each task goes through its stretch of a file once; a row for each stretch is compared with that before it."""
    lines = spark.read.text(path, lineSep="\n")
    own = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), (F.col("value") if key is None else key).alias("key"), F.col("value").alias("line"))
    runs = own.mapInArrow(_runs, _RUN)
    by_place = Window.orderBy("file", "at")
    before = F.struct(F.lag("last_key").over(by_place), F.lag("last_line").over(by_place))
    across = F.when(F.lag("file").over(by_place).isNotNull() & (F.struct("first_key", "first_line") < before), 1).otherwise(0)
    return runs.withColumn("across", across).groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.col("breaks") + F.col("across")).alias("breaks"))
