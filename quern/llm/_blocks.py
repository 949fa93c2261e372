"""Documents packed into blocks that stay where they were written, and meet other tables there."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ROW_GROUP_BYTES, new_table, small_batches
from . import _bytes as B

#: Bytes of text in a block; texts are deflated, so that a block is a few MB. Rows of a block.
BLOCK_BYTES = 12 << 20
BLOCK_ROWS = 1 << 20
#: Bytes of text that a file of blocks should hold, which is what one task joins; larger where MOST_FILES would be too few.
FILE_BYTES = 24 << 20
#: Where Spark's number of shuffle partitions decides, bytes of text in a file at least.
LEAST_FILE_BYTES = 256 << 10
#: Spark's own bound on the buckets of a table.
MOST_FILES = 100_000
#: A row's number is its block's number times this, plus its place.
ROW = 1 << 22


def _pack(at: int, most: int):
    """A task's rows as blocks: deflated Arrow tables of up to most bytes of text (one text at least)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def block() -> pa.RecordBatch:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
                for x in held:
                    w.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) + n]), pa.array([out.getvalue()])], ["block", "rows"])

        for b in batches:
            for i, j, data, _ in B.text_batches(b.column(at), 1 << 20):
                held.append(b.slice(i, j - i))
                size, rows = size + len(data), rows + j - i
                if size >= most or rows >= BLOCK_ROWS:
                    yield block()
                    n, held, size, rows = n + 1, [], 0, 0
        if held:
            yield block()

    return f


def n_files(docs: DataFrame, text_col: str, file_bytes: int | None = None) -> int:
    """Over how many files blocks of docs are dealt: by the bytes of text (this reads the column once)."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(max(1, -(-total // (file_bytes or FILE_BYTES))), MOST_FILES)


def pack(docs: DataFrame, text_col: str, most: int = BLOCK_BYTES) -> DataFrame:
    """A table (block, rows) of docs, dealt to files by block: a join on block moves only the other side, which may be much
    larger than the texts. So there are as many files as shuffle partitions, but no more than there are texts for."""
    packed = docs.mapInArrow(_pack(docs.columns.index(text_col), most), "block long, rows binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_files(packed, min(partitions, n_files(docs, text_col, LEAST_FILE_BYTES)))


def in_files(blocks: DataFrame, files: int) -> DataFrame:
    """blocks (with a column block) as a table dealt to so many files by block."""
    spark = blocks.sparkSession
    name, path = new_table(spark, "blocks")
    with small_batches(spark):
        blocks.write.bucketBy(files, "block").option("path", path).option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).saveAsTable(name)
    return spark.table(name)


def unpack(rows: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(rows) as r:
        yield from r


def each(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Numbers and rows of the blocks in a table."""
    for block, rows in zip(table.column("block"), table.column("rows"), strict=True):
        yield block.as_py(), rows.as_py()


def texts(x: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    yield from B.text_batches(x.column(x.schema.get_field_index(name)), 1 << 20)
