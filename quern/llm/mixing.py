"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranked
from ._shared import WORD, running_sums, stored, with_free_names

#: Weights that sources get in turn, in code point order with null last.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST_REPEATS = 3
#: How a source's weight changes over training, in turn: it goes from 1 - tilt to 1 + tilt of its mean.
TILTS = (-0.5, 0.0, 0.5)
#: Rows of a source that one running sum covers, on average.
BLOCK_ROWS = 4_000


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS) -> DataFrame:
    """sources (source, source_size: one row each; sizes are long) with weight, rank and target.

    The targets share the sum of all sizes by weight; a target over cap times its source's size stops
    there and the excess goes to the others by weight, until none is above. In order of size over weight,
    the sources that stop come first, so running sums decide it: a source stops if its share of what the
    ones before it leave is at least its cap. Sizes are summed as whole numbers and divided once. Ranks and running sums
    go by range partitions: no task has all sources, and four totals come to the driver.
    """
    s = ranked(sources, [F.col("source").asc_nulls_last()], "rank", 0)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = running_sums(s, [F.col("source_size") / F.col("weight"), "rank"], {"source_size": "sizes", "weight": "weights"})
    total, total_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    s = s.withColumn("left", F.lit(total or 0) - cap * F.col("sizes")).withColumn("left_weight", F.lit(total_weight or 0) - F.col("weights"))
    s = s.withColumn("stops", F.col("weight") * F.col("left") > cap * F.col("source_size") * F.col("left_weight"))
    rest = s.filter(~F.col("stops")).agg(F.max("left"), F.max("left_weight")).first()
    s = s.withColumn("rest", F.lit(rest[0]).cast("long")).withColumn("rest_weight", F.lit(rest[1]).cast("long"))
    target = F.when(F.col("stops"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight").cast("double"))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS, tilts: tuple[float, ...] = TILTS, seed: int = 29, block_rows: int = BLOCK_ROWS, size_col: str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies, taken and positions (where in training each copy stands).

    A source's documents lie in a seeded random order on a line, one after the other, and the line repeats.
    A copy is taken if its middle is before the source's target, so each source takes its target but for
    half a document. Over training time u from 0 to 1 a source's weight is its mean times
    1 + tilt (2u - 1); the integral, u + tilt (u^2 - u), is the share of its target that it has given by
    u. A copy that begins at share p stands where that integral is p, u = its inverse at p, and its
    position is the number of tokens all sources together have given by u.

    Running sums go by block: the order key's leading bits cut each source into blocks of about block_rows,
    so a source with most rows is no single task; the blocks' sums, a small table, are added on.

    size_col: a column of docs (long, not null) that has the sizes already; else they are the texts' words, which are
    counted twice (a scan each is less than moving the texts).

    Null sources are one source, the last. Null, empty and white texts have size 0 and are never taken; if a source has
    size 0, its target is 0. Very long texts count whole. Rows with null ids are placed by their texts; rows with
    equal ids (and, of null ids, equal texts) lie next to each other, and equal rows are interchangeable.
    An empty table gives no rows. Names of existing columns may be anything but the new ones. Runs jobs when called.
    """
    new = ["size", "source_size", "target", "copies", "taken", "positions"]
    if clash := set(new) & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    x = with_free_names(docs, ["source", "key", "block", "n", "bsum", "before", "start", "rank", "all", "lean", "weight"])
    c = {k: F.col(v) for k, v in x.items()}
    of = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    size = n_words(F.col(text_col)) if size_col is None else F.col(size_col)
    sized = docs.withColumn("size", size).withColumn(x["key"], F.md5(F.concat_ws(":", F.lit(seed).cast("string"), of)))
    lead = F.conv(F.substring(c["key"], 1, 8), 16, 10).cast("long")
    narrow = sized.select(F.col(source_col).alias("source"), "size", lead.alias("lead"))
    blocks = max(1, -(-narrow.count() // block_rows))
    by_block = stored(narrow.groupBy("source", F.floor(F.col("lead") * blocks / F.lit(1 << 32)).cast("long").alias("block")).agg(F.sum("size").alias("bsum"), F.count("*").alias("n")), "mix-blocks")
    sources = source_targets(by_block.groupBy("source").agg(F.sum("bsum").alias("source_size")), weights, cap)
    lean = F.element_at(F.array(*map(F.lit, tilts)), (F.col("rank") % len(tilts) + 1).cast("int")).cast("double")
    sources = sources.withColumn("lean", lean)
    sources = stored(sources, "mix-sources")
    ends = sources.agg(F.sum("target"), F.sum(F.col("target") * F.col("lean"))).first()
    sources = sources.withColumn("all_target", F.lit(ends[0] or 0.0)).withColumn("all_lean", F.lit(ends[1] or 0.0))
    before = F.sum("bsum").over(Window.partitionBy("source").orderBy("block")) - F.col("bsum")  # one row for block_rows rows
    table = by_block.withColumn("before", before)
    table = table.join(sources, table["source"].eqNullSafe(sources["source"])).select(
        table["source"].alias(x["source"]), F.col("block").alias(x["block"]), F.col("before").alias(x["before"]), "source_size", "target",
        F.col("lean").alias(x["lean"]), F.col("all_target").alias(x["all"]), F.col("all_lean").alias(x["weight"]),
    )
    table = stored(table, "mix-table")

    rows = sized.withColumn(x["n"], F.floor(lead * blocks / F.lit(1 << 32)).cast("long"))
    within = Window.partitionBy(source_col, x["n"]).orderBy(x["key"], id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(x["start"], F.sum("size").over(within) - F.col("size"))
    rows = rows.join(table, rows[source_col].eqNullSafe(table[x["source"]]) & (c["n"] == c["block"]))
    start = (c["before"] + c["start"]).cast("double")
    # Copy e (from 0) has its middle at e * source_size + start + size / 2.
    copies = F.greatest(F.lit(0), F.least(F.lit(cap), F.ceil(F.try_divide(F.col("target") - start - F.col("size") / 2, F.col("source_size"))))).cast("int")
    rows = rows.withColumn("copies", F.when((F.col("source_size") > 0) & (F.col("size") > 0), copies).otherwise(F.lit(0)))
    share = lambda e: F.least(F.lit(1.0), F.try_divide(e * F.col("source_size") + start, F.col("target")))
    g = c["lean"]
    # p = u + g (u^2 - u), solved for u so that g = 0 needs no case of its own.
    root = lambda p: F.sqrt(F.greatest((1 - g) * (1 - g) + 4 * g * p, F.lit(0.0)))
    moment = lambda p: F.coalesce(F.try_divide(2 * p, (1 - g) + root(p)), F.lit(0.0))
    place = lambda u: c["all"] * u + c["weight"] * (u * u - u)
    positions = F.transform(F.filter(F.array(*[F.lit(e) for e in range(cap)]), lambda e: e < F.col("copies")), lambda e: place(moment(share(e))))
    rows = rows.withColumn("taken", F.col("size") * F.col("copies")).withColumn("positions", positions)
    return rows.select(*docs.columns, *new)


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of mixed (what curriculum gives), range-sorted by the position of their first copy; those never taken come
    last, by id, so that they are no single range.

    All rows stay, those with null ids or texts and repeated ones too; equal positions follow by id. An empty table gives
    no rows. All columns are kept. Sorting runs a job that samples positions."""
    first = F.coalesce(F.element_at(F.col("positions"), F.when(F.size("positions") > 0, F.lit(1))), F.lit(float("inf")))
    return mixed.orderBy(first, id_col)


def copies_in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that is taken, with columns (of mixed, what curriculum gives), range-sorted by position.

    Rows never taken give none: those of null, empty or white texts, and of what is beyond a source's target.
    Repeated rows are each there as often as they are taken. An empty table gives no rows. The work column takes a
    name that mixed does not have. Sorting runs a job that samples positions."""
    name = with_free_names(mixed, ["position"])["position"]
    return mixed.select(*columns, F.explode("positions").alias(name)).orderBy(name).select(*columns)
