"""Two-pass external shuffle into shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored, with_free_names

#: Bytes of text that one bucket should hold at most, on average.
BUCKET_BYTES = 32 << 20
#: Buckets of all shards at most, which are partitions of one shuffle: of tables too large for that, buckets hold more.
MOST_BUCKETS = 100_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash of (key, shard): one more shard takes rows only into itself."""
    drawn = [F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*drawn) if shards > 1 else drawn[0])["s"]


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with the columns shard, bucket and slot: a seeded random order within each shard.

    Pass 1 scatters rows by seeded hashes: of the id to a shard, and of id and text to one of as many buckets of it
    as keep each near bucket_bytes (larger only where MOST_BUCKETS would not do). Pass 2 deals each bucket to a task of its own, numbers its rows in a sorted (and
    so repeatable, and spillable) order and puts them in the order of a Fisher-Yates permutation of the
    bucket, which is what Spark's shuffle() draws. Only the permutation, of integers, is held in memory;
    texts stream. slot counts from 0 in each shard without gaps, bucket after bucket.

    Law "key": id and number of shards alone decide the shard. Null ids share a shard, and rows with equal
    ids are in the same one, over all its buckets by their texts; rows with equal ids and texts share a bucket and
    are interchangeable in it. Null and empty texts are rows like any other; very long texts move whole; an empty table
    gives no rows. All columns are kept; shard, bucket and slot must not be among them. Runs jobs when called.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if clash := {"shard", "bucket", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    total = docs.agg(F.sum(text_bytes(F.col(text_col)))).first()[0] or 0
    buckets = max(1, min(-(-total // (shards * bucket_bytes)), MOST_BUCKETS // shards))
    key, text = F.col(id_col), F.col(text_col)
    bucket = F.pmod(F.xxhash64(key, F.xxhash64(text), F.lit(seed + 1)), F.lit(buckets)).cast("int")
    n = with_free_names(docs, ["number", "n", "before", "order", "rn"])
    placed = docs.withColumn("shard", shard_of(key, shards, seed)).withColumn("bucket", bucket)
    placed = placed.withColumn(n["number"], F.col("shard") * buckets + F.col("bucket"))

    counts = placed.groupBy("shard", "bucket", n["number"]).agg(F.count("*").alias(n["n"]))
    before = F.sum(n["n"]).over(Window.partitionBy("shard").orderBy("bucket")) - F.col(n["n"])
    order = F.shuffle(F.sequence(F.lit(0), (F.col(n["n"]) - 1).cast("int")), F.lit(seed))
    # Spark draws by task, in row order: buckets are dealt and sorted the same way each time.
    counts = counts.repartition(-(-shards * buckets // 64), "shard", "bucket").sortWithinPartitions("shard", "bucket")
    counts = stored(counts.select(n["number"], before.alias(n["before"]), order.alias(n["order"])), "shard-buckets")

    # By number: task i has bucket i and nothing else.
    deal = lambda df: df.repartitionById(shards * buckets, F.col(n["number"]))
    within = Window.partitionBy(n["number"]).orderBy(F.xxhash64(key, F.lit(seed + 2)), key, F.xxhash64(text))
    rows = deal(placed).withColumn(n["rn"], F.row_number().over(within))
    slot = (F.col(n["before"]) + F.element_at(n["order"], F.col(n["rn"]))).cast("long")
    return rows.join(deal(counts), n["number"]).select(*docs.columns, "shard", F.col("bucket").cast("long").alias("bucket"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled shards as Parquet: a folder shard=i for each shard that has rows, in it a file for each bucket
    that has rows, in slot order; files by name are in order of bucket.

    Rows with null ids, null, empty or very long texts and repeated rows are written like any other (see
    shuffle_into_shards); an empty table gives no files. All columns are kept; shard, bucket and slot must
    not be among them. path must not exist."""
    placed = shuffle_into_shards(docs, shards, seed, id_col, text_col, bucket_bytes)
    # The task that shuffled a bucket writes it.
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
