"""Exact deduplication by 128-bit content hash, with bytes compared inside groups. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, join_groups, stored, with_free_names


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", "")


#: Hashes that more than one row has are broadcast up to this number (8 bytes each), so that no other text moves.
MOST_BROADCAST = 1 << 22


def _grouped(rows: DataFrame, hashes: Callable[[Column], Column]) -> DataFrame:
    """Rows (id, text, row) with h, sha, group_size, best (of its row) of their group, and without the text."""
    norm = normalised(F.col("text"))
    h = lambda c: F.encode(hashes(c).cast("string"), "UTF-8")
    narrow = rows.select("id", "row", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), h(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    narrow = stored(narrow, "exact-rows")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    groups = stored(narrow.groupBy("h", "sha").agg(F.count("*").alias("group_size"), best), "exact-groups")
    # Only texts whose hash another row has can be copies, or differ in spite of it.
    again = groups.groupBy("h").agg(F.sum("group_size").alias("n")).filter("n > 1").select(F.xxhash64("h").alias("again")).distinct()
    texts = rows.select(norm.alias("norm")).withColumn("h", h(F.col("norm")))
    if again.count() <= MOST_BROADCAST:
        texts = texts.join(F.broadcast(again), F.xxhash64("h") == F.col("again"), "left_semi")
    variants = texts.groupBy("h", "norm").agg(F.lit(1).alias("one")).groupBy("h", F.sha2("norm", 256).alias("sha"))
    if (variants.agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1) > 1:
        raise ValueError("two different texts share both hashes")
    return join_groups(narrow, groups, ["h", "sha"], "group_size", narrow.count())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Rows are grouped by content_hash (MD5: 128 bits) of the normalised text. Of a group, the row with the
    most code points stays, then that with the smallest id (null last), then the first one read: exactly
    one row of a group has kept, also if ids or whole rows repeat. Null text is empty text, very long texts are hashed and
    compared whole. An empty table gives no rows; other columns are not looked at. Runs jobs when called.

    Bytes are compared: rows whose hash more than one row has are also grouped by hash and whole normalised text, where Spark
    compares the bytes of equal hashes and merges copies before the shuffle, so that a group of any size is one
    row for each task. Other texts do not move, as long as these hashes are MOST_BROADCAST at most; beyond, all
    distinct texts do. A hash with several texts is a collision; its group is split by the texts'
    SHA-256, after the same comparison has shown that no SHA-256 has two texts either.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _grouped(rows, content_hash).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns: exactly one of each group.

    docs is written once with a number for each row, by which the rows that stay are found again; so rows without an id, or
    that repeat one, need not meet, however many they are. Null text is empty text; very long texts are compared whole. An
    empty table gives no rows. All columns are kept; work columns take names that docs does not have. Runs jobs when
    called.
    """
    row = with_free_names(docs, ["row"])["row"]
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "exact-docs")
    rows = own.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(row).alias("row"))
    kept = _grouped(rows, F.md5).filter(F.col("row") == F.col("best.row")).select(F.col("row").alias(row))
    return own.join(kept, row, "left_semi").select(*docs.columns)
