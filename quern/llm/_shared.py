"""What several operators need: shared scratch tables, hot-key joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scope, small_batches, stored

#: The characters that separate words and that exact comparison ignores.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A group is hot if it holds more than one row in so many; hence there are fewer hot groups than this.
HOT_SHARE = 1000


def whole_ids(df: DataFrame, id_col: str) -> None:
    """An error unless id_col holds whole numbers."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold whole numbers, not {kind}: number the rows first")


def with_free_names(df: DataFrame, wanted: list[str]) -> dict[str, str]:
    """For each wanted work column, a name that df does not have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for w in wanted:
        name = f"__{w}"
        while name.lower() in taken:
            name = f"_{name}"
        names[w] = name
        taken.add(name.lower())
    return names


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each column (of whole numbers) in sums, the sum over all rows before in a total order, 0 in the first.
    No task sees all rows: they are sorted by range partition, written once, and summed within their partition;
    to this come the sums of the partitions before, of which there is one row each."""
    x = with_free_names(df, ["id", "part", *(f"before_{k}" for k in sums)])
    within = Window.partitionBy(x["part"]).orderBy(x["id"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored(df.orderBy(*order).withColumn(x["id"], F.monotonically_increasing_id()), "running")
    placed = placed.withColumn(x["part"], F.shiftright(x["id"], 33))  # Spark's row ids: the partition's number above
    parts = placed.groupBy(x["part"]).agg(*[F.sum(k).alias(k) for k in sums])
    parts = parts.select(x["part"], *[(F.sum(k).over(Window.orderBy(x["part"])) - F.col(k)).alias(x[f"before_{k}"]) for k in sums])
    out = placed.select("*", *[(F.sum(k).over(within) - F.col(k)).alias(name) for k, name in sums.items()]).join(F.broadcast(parts), x["part"])
    return out.select(*df.columns, *[(F.col(name) + F.col(x[f"before_{k}"])).cast("long").alias(name) for k, name in sums.items()])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of their group; groups has one row for each value of keys and its size.

    Hot groups (over total / HOT_SHARE rows each, so under HOT_SHARE of them) are broadcast, whatever
    the input's size; the rest, none of which can fill a task, are joined by shuffle.
    """
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    near = rows.join(hot, keys, "inner")
    far = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(size) <= limit), keys, "inner")
    return near.unionByName(far)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, component) for each vertex with an
    edge to another one; component is the smallest id reached. Edges to itself and nulls are ignored.

    Large star and small star alternate until the edges are stars. Each is a minimum by vertex (combined
    before the shuffle), which is written, and a join with it: by broadcast while it is small, later by
    shuffle, where Spark splits the rows of vertices with very many edges. Edges are written to the shared
    folder each time, where a round's tables go when the next one's are there, and never come to the driver.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    print_of = lambda x: x.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    least_of = lambda x: stored(x.groupBy("a").agg(F.min("b").alias("m")), name)
    with Scope(spark) as own:
        e = stored(e, name)
        for _ in range(rounds):
            before = print_of(e)
            # Large star: every larger neighbour of a vertex goes to the least of the vertex and its neighbours.
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = both.join(least_of(both), "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            large = stored(large.distinct(), name)
            least = least_of(large)
            # Nothing moved and each vertex has one smaller neighbour: these are stars.
            if print_of(large) == before and least.count() == before[0]:
                break
            # Small star: a vertex and its smaller neighbours go to the least of these.
            small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            e = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
            own.drop(e)
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        own.drop(e)
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def linked_classes(classes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """classes (rep, weight, ...) with n_links of each member and component.

    found: (id, links, root), any number of rows for a class: links to sum up, and a class that it is
    connected with. The members of a class are linked with one another.
    """
    found = stored(found, name)
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), name).withColumnRenamed("id", "rep")
    out = classes.join(links, "rep", "left").join(reached, "rep", "left")
    return out.withColumn("n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0))).withColumn("component", F.coalesce("component", "rep")).drop("links")
