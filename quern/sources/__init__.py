"""Reading documents, lines and key/value records; writing results."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The one record type that goes through a job.
KV = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
#: Its form as JSON lines.
KV_JSON = T.StructType([T.StructField("Key", T.StringType()), T.StructField("Value", T.StringType())])


def _file_name(paths: list[str]) -> Column:
    """A row's file by its path; local files as they are given, so relative to the working folder if paths are."""
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(name, "^file:/+", "/")
    here = f"{os.getcwd()}/"
    if not any(p.startswith("/") or ":" in p for p in paths):
        name = F.when(name.startswith(here), F.substring(name, F.lit(len(here) + 1), F.length(name))).otherwise(name)
    return name


def _listings(paths: list[str]) -> list[list[str]]:
    """Spark lists a path once: what is given n times is in n lists."""
    rounds: list[list[str]] = []
    for p in paths:
        own = next((r for r in rounds if p not in r), None)
        if own is None:
            rounds.append(own := [])
        own.append(p)
    return rounds


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(document, contents): one row, and so one task, for each file, named by its path; for functions that need a whole file.
    A file that is listed twice is read twice."""
    read = [spark.read.text(some, wholetext=True).select(_file_name(paths).alias("document"), F.col("value").alias("contents")) for some in _listings(paths)]
    return reduce(DataFrame.unionByName, read)


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(document, copy, line): a row for each line that is not empty, with its file's path; only line feeds end a line. Files of any size are
    read in splits, by many tasks. A file that is listed twice is read twice: copy tells which listing a row is of."""
    read = [
        spark.read.text(some, lineSep="\n").filter("value <> ''").select(_file_name(paths).alias("document"), F.lit(i).alias("copy"), F.col("value").alias("line"))
        for i, some in enumerate(_listings(paths))
    ]
    return reduce(DataFrame.unionByName, read)


def contents(spark: SparkSession, paths: list[str], by_line: bool) -> DataFrame:
    """(document, contents) of whole files, or of their lines."""
    return file_lines(spark, paths).select("document", F.col("line").alias("contents")) if by_line else documents(spark, paths)


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """line: the lines that are not empty. Only line feeds end a line; a carriage return stays in it."""
    return spark.read.text(paths, lineSep="\n").filter("value <> ''").withColumnRenamed("value", "line")


def kv_json(spark: SparkSession, path: str | list[str], *more: Column) -> DataFrame:
    """(key, value) from JSON lines, and more columns (of the file's metadata); malformed input is an error."""
    read = spark.read.schema(KV_JSON).json(path, mode="FAILFAST")
    return read.select(F.col("Key").alias("key"), F.col("Value").alias("value"), *more)


def write_kv_json(kv: DataFrame, path: str, parts: str | None = None) -> None:
    """Write (key, value) as JSON lines; with parts, a folder for each value of that column."""
    named = kv.select(F.col("key").alias("Key"), F.col("value").alias("Value"), *([parts] if parts else []))
    (named.write.partitionBy(parts) if parts else named.write).mode("overwrite").json(path)


def final_line(key: str = "key", value: str = "value", form: str = "key: value"):
    """A result's line: "key: value", or the value alone."""
    if form not in ("key: value", "value"):
        raise ValueError(f"no such form: {form}")
    return F.concat(key, F.lit(": "), F.col(value).cast("string")) if form == "key: value" else F.col(value).cast("string")


def write_final(kv: DataFrame, path: str, form: str = "key: value", single: bool = False) -> None:
    """Write lines as kv has them, a file for each of its partitions: part files of a job's result follow one another in
    order of key. With single, there is one file in order of key (all rows then go through one task: for results that
    a person reads)."""
    rows = kv.orderBy("key", "value").coalesce(1) if single else kv
    rows.select(final_line(form=form).alias("line")).write.mode("overwrite").text(path)
