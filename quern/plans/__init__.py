"""Jobs: a map and a reduce step under a short name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from .. import sources
from ..functions import sort_key, words
from ..operators.segments import value_segments
from .ranges import by_size, by_split_points


@dataclass(frozen=True)
class JobSpec:
    """What to run on what. partitions: of the result, more if these would be too large, None for Spark's choice; sample: split points come from it;
    most: rows of a range between split points that are not cut again, None for a bound by the even share."""

    job: str
    inputs: tuple[str, ...]
    partitions: int | None = None
    sample: str | None = None
    most: int | None = None

    def __post_init__(self):
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("the number of partitions must be at least 1")
        if not self.inputs:
            raise ValueError("no inputs")


@dataclass(frozen=True)
class Job:
    """mapper: (spark, spec) -> (key, value); reducer: that -> (key, value); form: of a result's line."""

    mapper: Callable[[SparkSession, JobSpec], DataFrame]
    reducer: Callable[[DataFrame], DataFrame]
    form: str = "key: value"


JOBS: dict[str, Job] = {}


def register(name: str, job: Job) -> None:
    if name in JOBS:
        raise ValueError(f"job {name} exists already")
    JOBS[name] = job


def job_of(name: str) -> Job:
    if name not in JOBS:
        raise KeyError(f"no such job: {name}; there are {', '.join(sorted(JOBS))}")
    return JOBS[name]


def run_job(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """The job's (key, value) rows in order of key: in as many sorted ranges as spec.partitions says, or more if these would be
    too large, or with a sample one for each range between its split points, or several for a range that is too large (finding
    these runs jobs; the rest is lazy)."""
    job = job_of(spec.job)
    out = job.reducer(job.mapper(spark, spec))
    if spec.partitions is None:
        return out.orderBy("key", "value")
    if spec.sample is None:
        return by_size(out, spec.partitions).sortWithinPartitions("key", "value")
    splits = O.split_points(sources.lines(spark, [spec.sample]), spec.partitions)
    return by_split_points(out, splits, spec.most).sortWithinPartitions("key", "value")


def _word_counts(pairs: DataFrame) -> DataFrame:
    return O.sum_values(pairs).select("key", F.col("total").cast("string").alias("value"))


def _index(found: DataFrame) -> DataFrame:
    """Of each key how many listed files have it, and these in order: (key, value, copy) may repeat, and tasks make their own
    distinct before the shuffle, so that pairs are dealt once and a task sorts them by key where it lacks room for a table of them."""
    files = F.array_sort(F.collect_set(F.struct("value", "copy")))
    listed = found.groupBy("key").agg(files.getField("value").alias("v"))
    return listed.select("key", F.concat_ws(" ", F.size("v").cast("string"), F.array_join("v", ",")).alias("value"))


def _lines(spark: SparkSession, spec: JobSpec) -> DataFrame:
    return sources.lines(spark, list(spec.inputs)).select(sort_key(F.col("line")).alias("key"), F.col("line").alias("value"))


def _words(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """Words line by line, as none crosses a line feed: files of any size are read in splits."""
    return O.emit_pairs(sources.file_lines(spark, list(spec.inputs)), "line")


def _words_in_lines(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """(word, file, copy) once for each word of a line; copy as in sources.file_lines."""
    return sources.file_lines(spark, list(spec.inputs)).select(F.explode(F.array_distinct(words(F.col("line")))).alias("key"), F.col("document").alias("value"), "copy")


def _words_by_file(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """(word, file) once for each listed file that has the word: distinct in a line, in a task, then over tasks."""
    return _words_in_lines(spark, spec).distinct().select("key", "value")


def _segments(pairs: DataFrame) -> DataFrame:
    """The index of which no line has more than operators.segments.SEGMENT files: "segment n files"."""
    found = value_segments(pairs)
    return found.select("key", F.concat_ws(" ", F.format_string("%09d", "segment"), F.col("n").cast("string"), F.array_join("values", ",")).alias("value"))


register("wc", Job(_words, _word_counts))
register("ii", Job(_words_in_lines, _index))
register("iis", Job(_words_by_file, _segments))
register("srt", Job(_lines, lambda kv: kv, "value"))


# Steps in Python


Pairs = Iterable[tuple[str, str]]
#: Pairs that a task holds before it hands them on, or combines them.
HELD = 200_000


def _frame(pairs: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["key", "value"], dtype=object)


def map_documents(docs: DataFrame, doc: str, text: str, f: Callable[[str, str], Pairs], combine: Callable[[str, Iterator[str]], str] | None = None) -> DataFrame:
    """(key, value) pairs that f(document, contents) gives for each row, handed on HELD at a time. A null text is empty.

    With combine, the values of a key among these are first made one: give it if reducing such values gives what
    reducing all of them does (sums, not averages). Then a frequent key sends few rows, not one for each pair."""

    def combined(pairs: list[tuple[str, str]]) -> pd.DataFrame:
        if combine is None:
            return _frame(pairs)
        by_key: dict[str, list[str]] = {}
        for k, v in pairs:
            by_key.setdefault(k, []).append(v)
        return _frame([(k, combine(k, iter(v))) for k, v in by_key.items()])

    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            for d, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                for pair in f(d, t):
                    held.append(pair)
                    if len(held) >= HELD:
                        yield combined(held)
                        held = []
        if held:
            yield combined(held)

    return docs.select(F.col(doc).cast("string"), F.coalesce(F.col(text), F.lit(""))).mapInPandas(g, sources.KV)


def reduce_by_key(kv: DataFrame, f: Callable[[str, Iterator[str]], str]) -> DataFrame:
    """(key, f(key, values)) for each key. Rows are dealt by key and sorted, and a task goes through them once: f gets
    the values, in order, as an iterator, so that not even one key's are in memory. A partition without rows gives none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str]]:
        for b in batches:
            yield from zip(b["key"], b["value"], strict=True)

    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        for key, group in groupby(rows(batches), key=lambda kv: kv[0]):
            done.append((key, f(key, (v for _, v in group))))
            if len(done) >= 10_000:
                yield _frame(done)
                done = []
        if done:
            yield _frame(done)

    return kv.repartition("key").sortWithinPartitions("key", "value").mapInPandas(g, sources.KV)


def python_job(map_f: Callable[[str, str], Pairs], reduce_f: Callable[[str, Iterator[str]], str], form: str = "key: value", combine: Callable[[str, Iterator[str]], str] | None = None, by_line: bool = False) -> Job:
    """A job of a user's own map and reduce functions. by_line: map_f gets a file's name and one of its lines, so that large
    files are read in splits, in place of the name and all of the file."""
    return Job(lambda spark, spec: map_documents(sources.contents(spark, list(spec.inputs), by_line), "document", "contents", map_f, combine), lambda kv: reduce_by_key(kv, reduce_f), form)
