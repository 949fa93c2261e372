"""DataFrame operators: flat-map, grouping, merging, ranking, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sort_key, split_lines, words
from ..storage import stored


# Map side


def tokenize(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, word) for each word of each document."""
    return docs.select(doc, F.posexplode(words(F.col(text))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


def emit_pairs(docs: DataFrame, text: str) -> DataFrame:
    """(word, "1") for each word."""
    return docs.select(F.explode(words(F.col(text))).alias("key"), F.lit("1").alias("value"))


def distinct_tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(word, doc) once for each word of a row; made distinct in the row, without a shuffle."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"), F.col(doc).cast("string").alias("doc"))


def line_records(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(split_lines(F.col(text))).alias("line"))


def keyed_lines(lines: DataFrame) -> DataFrame:
    """(key, value) with the line's sort key and the whole line."""
    return lines.select(sort_key(F.col("line")).alias("key"), F.col("line").alias("value"))


# Reduce side


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n); summed in each task before the shuffle."""
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def sum_values(kv: DataFrame) -> DataFrame:
    """(key, total) of values that are whole numbers as text; anything else is an error."""
    return kv.groupBy("key").agg(F.sum(F.col("value").cast("bigint")).alias("total"))


def count_values(kv: DataFrame) -> DataFrame:
    return kv.groupBy("key").agg(F.count("*").alias("n"))


def joined_values(kv: DataFrame) -> DataFrame:
    """(key, n, joined): the values in bytewise order, repeats kept, joined by commas. A list is the result
    here, so a key's values meet; make them distinct before."""
    listed = kv.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return listed.select("key", F.size("v").cast("bigint").alias("n"), F.array_join("v", ",").alias("joined"))


def concat_lines(kv: DataFrame) -> DataFrame:
    """(key, n, text): the lines of a key, in order, joined by line feeds."""
    listed = kv.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return listed.select("key", F.size("v").cast("bigint").alias("n"), F.array_join("v", "\n").alias("text"))


def inverted_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(word, n, docs): the documents that hold a word, a comma between them; a document that is listed twice
    counts twice."""
    pairs = distinct_tokens(docs, doc, text).withColumnsRenamed({"word": "key", "doc": "value"})
    return joined_values(pairs).withColumnsRenamed({"key": "word", "joined": "docs"})


def last_wins(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Of each key the values of the row that is last in order."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return df.groupBy(key).agg(last).select(key, "last.*")


def merge_parts(*parts: DataFrame) -> DataFrame:
    """Merge (key, value) results of partitions; of a key that several have, the last part's value stays."""
    numbered = [p.select("key", "value", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    union = numbered[0]
    for p in numbered[1:]:
        union = union.unionByName(p)
    return last_wins(union, "key", ["part"], ["value"])


# Order


def total_sort(lines: DataFrame) -> DataFrame:
    """(key, value) of all lines in order of key, then line: range partitions, each sorted."""
    return keyed_lines(lines).orderBy("key", "value")


def ranked(df: DataFrame, order: list[str | Column], name: str = "rn", start: int = 1) -> DataFrame:
    """df with each row's place in a total order. No task sees all rows: rows are sorted by range partition,
    written once, and numbered as they lie."""
    return numbered(df.orderBy(*order), name, start)


def numbered(df: DataFrame, name: str = "rn", start: int = 1, tasks: int | None = None) -> DataFrame:
    """df, written once, with each row's place among all as they lie: that in its partition plus the rows of the partitions
    before, of which there is one number each. tasks: how many at most write it, each some partitions one after another, for df of very
    many small ones, which would be a file each."""
    bits = 33  # Spark's row ids: the partition's number above, the row's place in it below
    placed = df.withColumn("__id", F.monotonically_increasing_id())
    placed = stored(placed if tasks is None else placed.coalesce(tasks), "ranked")
    part = F.shiftright("__id", bits)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    offsets = counts.select("__part", before.alias("__before"))
    place = F.col("__id").bitwiseAND(F.lit((1 << bits) - 1)) + F.col("__before") + start
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, place.cast("bigint").alias(name))


def systematic_sample(lines: DataFrame, n: int, column: str = "line") -> DataFrame:
    """(pos, column): of the sorted rows of column those at 0, step, 2 step, ...; step is rows // n, at least 1."""
    if n < 1:
        raise ValueError("the number of partitions must be at least 1")
    rows = lines.select(column)
    step = max(1, rows.count() // n)
    return ranked(rows, [column], "pos", 0).filter(F.col("pos") % step == 0)


def split_points(lines: DataFrame, n: int, column: str = "line") -> list[str]:
    """The systematic sample as a sorted list: under 2 n values."""
    return [r[0] for r in systematic_sample(lines, n, column).orderBy("pos").select(column).collect()]
