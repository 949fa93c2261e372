"""Lists that are longer than a row may be, as rows of a bounded part each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Values in a segment at most.
SEGMENT = 10_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted (key, value) rows of a partition as a row for each run of a key in a batch: key, at (the place of its first row),
    values."""
    at = 0
    for b in batches:
        n, key = b.num_rows, b.column(0)
        if not n:
            continue
        new = pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero(new) + 1]).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, n), pa.int32()), b.column(1))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(begins)), pa.array(begins + at), lists], ["key", "at", "values"])
        at += n


def value_segments(kv: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(key, segment, first, last, n, values): the sorted values of each key, repeats kept, in segments of at most most
    values, numbered from 0; all but a key's last are full. first and last are a segment's least and greatest value.

    Pairs are range-sorted by key and value, so a key with very many values lies in many tasks, and written once, as runs: a row
    for the values of a key that are next to one another in a batch. The place of a run among the values of its key is its place in
    its range, and the pairs of the key in the ranges before: of these there is a number for each key and range. Only runs, cut
    where segments end, are dealt again, and only a segment's values ever meet in one row."""
    if most < 1:
        raise ValueError("a segment must hold at least one value")
    pairs = kv.select("key", "value").orderBy("key", "value")
    key, value = pairs.schema.fields
    kind = T.StructType([T.StructField("key", key.dataType), T.StructField("at", T.LongType()), T.StructField("values", T.ArrayType(value.dataType))])
    placed = stored(pairs.mapInArrow(_runs, kind).withColumn("part", F.spark_partition_id()), "segments")
    by_key = Window.partitionBy("of")
    size = F.size("values").cast("bigint")
    runs = placed.groupBy(F.col("key").alias("of"), F.col("part").alias("in")).agg(F.sum(size).alias("n"), F.min("at").alias("begin"))
    runs = runs.withColumn("all", F.sum("n").over(by_key)).withColumn("before", F.sum("n").over(by_key.orderBy("in")) - F.col("n"))
    # Keys of one segment, nearly all, need no place.
    long = runs.filter(F.col("all") > most).select("of", "in", (F.col("before") - F.col("begin")).alias("shift"))
    rows = placed.join(long, F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")), "left")
    place = F.col("at") + F.col("shift")

    def piece(segment: Column) -> Column:
        skipped = F.greatest(segment * most - place, F.lit(0).cast("bigint"))
        end = F.least((segment + 1) * most - place, size)
        return F.struct(segment.alias("segment"), F.slice("values", (skipped + 1).cast("int"), (end - skipped).cast("int")).alias("values"))

    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("segment"), F.col("values").alias("values")))
    cut = F.transform(F.sequence(F.floor(place / most).cast("bigint"), F.floor((place + size - 1) / most).cast("bigint")), piece)
    pieces = rows.select("key", "part", "at", F.explode(F.when(F.col("shift").isNull(), whole).otherwise(cut)).alias("p"))
    held = pieces.groupBy("key", F.col("p.segment").alias("segment")).agg(F.array_sort(F.collect_list(F.struct("part", "at", "p.values"))).alias("held"))
    held = held.select("key", "segment", F.flatten("held.values").alias("all"))
    values = F.array_compact("all")
    return held.select("key", "segment", F.array_min("all").alias("first"), F.array_max("all").alias("last"), F.size("all").cast("bigint").alias("n"), values.alias("values"))


def index_segments(pairs: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(word, segment, first, last, n, docs) of distinct (word, doc): an inverted index whose lists may have any length."""
    found = value_segments(pairs.select(F.col("word").alias("key"), F.col("doc").alias("value")), most)
    return found.withColumnsRenamed({"key": "word", "values": "docs"})


def postings(index: DataFrame, *words: str) -> DataFrame:
    """(word, doc) of some words of index_segments, in order: their segments joined, a row for each document."""
    found = index.filter(F.col("word").isin(*words)).orderBy("word", "segment")
    return found.select("word", F.explode("docs").alias("doc"))


def documents_with_all(index: DataFrame, *words: str) -> DataFrame:
    """doc: the documents that all of these words have in their lists. Segments that end before the first document, or begin
    after the last one, that all lists reach to are not read further."""
    wanted = sorted(set(words))
    own = index.filter(F.col("word").isin(*wanted))
    ends = own.groupBy("word").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    low, high, n = ends.agg(F.max("first"), F.min("last"), F.count("*")).first()
    if n < len(wanted):
        return own.select(F.explode("docs").alias("doc")).filter("false")
    near = own.filter((F.col("last") >= low) & (F.col("first") <= high))
    held = near.select("word", F.explode("docs").alias("doc")).groupBy("doc").agg(F.count_distinct("word").alias("n"))
    return held.filter(F.col("n") == n).select("doc")


def write_index(index: DataFrame, path: str) -> None:
    """index as Parquet in order of word and segment, so that a reader skips row groups without the words it wants."""
    index.repartitionByRange("word", "segment").sortWithinPartitions("word", "segment").write.parquet(path)
