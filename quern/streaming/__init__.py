"""Word counts that follow a folder as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words


def stream_word_counts(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A streaming (word, n) over all text files of folder so far; to be written in complete or update mode."""
    read = spark.readStream.option("lineSep", "\n")  # no word crosses a line feed, so large files are read in splits
    read = read.option("maxFilesPerTrigger", max_files) if max_files else read
    return read.text(folder).select(F.explode(words(F.col("value"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
