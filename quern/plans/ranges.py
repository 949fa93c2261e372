"""Rows dealt to ordered ranges, of which none may be too large for a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import splits_below
from ..operators import ranked
from ..storage import stored

#: A range is cut again if it has over so many times its even share of the rows, and over so many rows.
UNEVEN = 4
LEAST_ROWS = 1_000_000
#: Bytes of keys and values in a range that by_size makes, about.
RANGE_BYTES = 64 << 20
#: Characters of a value that its range is told by.
PREFIX = 256


def by_size(kv: DataFrame, n: int) -> DataFrame:
    """Deal rows to n ordered ranges of key and value, or to more if these would hold over RANGE_BYTES each: what a task sorts
    does not grow with the input. kv is written once (a job) and its bytes are added up.

    Rows of one key are told apart by PREFIX characters of their values, as what ranges are found by is sampled for the driver,
    and values may be long lists."""
    kv = stored(kv.select("key", "value"), "sized")
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    total = kv.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return kv.repartitionByRange(max(n, -(-total // RANGE_BYTES)), "key", F.substring("value", 1, PREFIX))


def by_split_points(kv: DataFrame, splits: list[str], most: int | None = None) -> DataFrame:
    """Deal rows to ranges between the split points: range i is partition i, empty ones included, unless it is too large.

    Ranges are counted first (a job, for which kv is computed; a number for each). One of over most rows (unless told, UNEVEN times the even share and
    LEAST_ROWS) is cut again, into as many equal partitions as it needs: kv is written once, the rows of such ranges are sorted by
    key and value, written, and dealt by their place, so the driver gets no row of them; partitions keep following one another in
    order. Rows that are equal in both lie in any order, so not even one row that fills a range is one task's. Thus split points
    from an old sample, or one of other data, cost balance at most."""
    part = F.col("__range")
    placed = kv.select("key", "value", splits_below(F.col("key"), splits).alias("__range"))
    sizes = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    total, ranges = sum(sizes.values()), len(splits) + 1
    most = max(LEAST_ROWS, UNEVEN * total // ranges) if most is None else most
    if most < 1:
        raise ValueError("a range must hold at least one row")
    if all(n <= most for n in sizes.values()):
        return placed.repartitionById(ranges, part.cast("int")).drop("__range")
    # Of each range: its first partition, into how many it is cut, its rows, and the place of its first row among those that are cut.
    cuts, to, at = [], 0, 0
    for p in range(ranges):
        n = sizes.get(p, 0)
        cuts.append((p, to, max(1, -(-n // most)), n, at))
        to += cuts[-1][2]
        at += n if n > most else 0
    table = placed.sparkSession.createDataFrame(cuts, "__range long, __first long, __parts long, __n long, __begin long")
    placed = stored(placed, "ranges")  # where equal rows go depends on their place, so that is fixed
    large = part.isin(*[p for p, n in sizes.items() if n > most])
    tie = F.xxhash64(F.monotonically_increasing_id())
    cut = ranked(placed.filter(large).withColumn("__tie", tie), ["__range", "key", "value", "__tie"], "__at", 0).drop("__tie")
    dealt = placed.filter(~large).withColumn("__at", F.lit(None).cast("bigint")).unionByName(cut).join(F.broadcast(table), "__range")
    own = F.coalesce(F.expr("(__at - __begin) * __parts div __n"), F.lit(0))
    return dealt.withColumn("__to", (F.col("__first") + own).cast("int")).repartitionById(to, F.col("__to")).select("key", "value")
