"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import components, join_groups, linked_classes, small_batches, stored, whole_ids, with_free_names

#: Rows of the incidence matrix in a block, and entries: more than so many on average, and blocks have fewer rows.
BLOCK_ROWS, BLOCK_ENTRIES = 1024, 1 << 21
#: Keys that a task holds until those of several sets become one row.
HELD_KEYS = 1 << 21
#: Keys are sorted in so many parts (a power of 2, 256 at most), and rows leave a task so many at a time.
KEY_PARTS, ROWS_OUT = 16, 1 << 17
#: n-grams in so many texts or more, of so many bytes of text that follow one another, may be common ones, of
#: which there are so many at most.
LOCAL, COUNTED, MOST_COMMON = 4, 8 << 20, 200_000
#: Columns with at least so many entries in a block are multiplied as dense ones, the others pair by pair.
DENSE = 8


def size_levels(most: int, num: int, den: int) -> np.ndarray:
    """First set size of each level. Sets that link are of one level or of neighbouring ones."""
    first = [1]
    while first[-1] <= most:
        first.append(first[-1] * den // num + 1)
    return np.array([*first, first[-1] * den // num + 1], np.int64)


def parts_of(level: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By how many n-grams at most two linked sets of a level differ, how many spare parts there are, and
    the number of parts, over the level as large as its largest sets need."""
    differ = (den - num) * 2 * (first[level + 1] - 1) // (den + num)
    spare = 2 + differ // 8
    return differ, spare, differ + 1 + spare


def block_keys(grams: np.ndarray, count: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (row, key) such that two different sets with Jaccard at least num / den share a key.

    n-grams in common (any sorted ones, the same for all sets) are left aside: the rest of two linked sets
    differs no more than they do. At a level where linked sets differ by up to d n-grams, the rest is dealt by
    hash to d + 1 + s parts. Two linked sets have at least 1 + s equal parts; each part's sum of hashes is
    a key. Empty parts give no key: a pair without a common key then has over s empty parts on both sides,
    and such sets get a prefix of count - ceil(count * num / den) + 1 n-grams as keys too, the least hashes
    first and those in common last, which linked sets share. So a passage that many documents hold makes no
    key but for sets that consist of such passages. Sets of levels with d = 0 link with equal ones only
    and need no keys.
    """
    rows = np.flatnonzero(count)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, B.U)
    first = size_levels(int(count.max()), num, den)
    level = np.searchsorted(first, count[rows], "right") - 1
    up = count[rows] * den >= num * first[level + 1]
    entry = np.concatenate([np.arange(len(rows)), np.flatnonzero(up)])
    tag = np.concatenate([level, level[up] + 1])
    differ, spare, parts = parts_of(tag, np.append(first, first[-1] * den // num + 1), num, den)
    used = differ > 0
    entry, tag, spare, parts = entry[used], tag[used], spare[used], parts[used]
    if not len(entry):
        return np.zeros(0, np.int64), np.zeros(0, B.U)
    n = count[rows][entry]
    at = (np.cumsum(count) - count)[rows][entry]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    if common is None or not len(common):
        aside = np.zeros(len(grams), bool)
    else:
        aside = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
        order = np.lexsort((aside, np.repeat(np.arange(len(count)), count)))  # stable: by hash on either side
        grams, aside = grams[order], aside[order]
    where = np.repeat(at, n) + place
    h, rest = grams[where], ~aside[where]
    base = np.cumsum(parts) - parts
    part = np.repeat(base, n) + (h % np.repeat(parts, n).astype(B.U)).astype(np.int64)
    total = np.zeros(int(parts.sum()), B.U)
    with np.errstate(over="ignore"):
        np.add.at(total, part[rest], B.mixed(h[rest], 4))
        filled = np.bincount(part[rest], minlength=len(total)) > 0
        own = np.repeat(np.arange(len(entry)), parts)
        number = (np.arange(len(total)) - base[own]).astype(B.U)
        key = B.mixed(total + B.mixed(number + (tag[own].astype(B.U) << B.U(40)), 5), 6)
        empty = parts - np.bincount(own[filled], minlength=len(entry))
        thin = empty > spare
        low = n - -(-n * num // den) + 1
        pick = np.repeat(thin, n) & (place < np.repeat(low, n))
        thin_key = B.mixed(h[pick] + B.mixed(np.repeat(tag, n)[pick].astype(B.U), 7), 8)
        thin_own = np.repeat(np.arange(len(entry)), n)[pick]
    who = rows[entry[np.concatenate([own[filled], thin_own])]]
    return who, np.concatenate([key[filled], thin_key])


def overlaps(column: np.ndarray, size: np.ndarray, left: int) -> np.ndarray:
    """The product of the incidence matrix's first left rows with the transpose of the others (of all
    rows, if left is their number): how many n-grams each pair of sets shares. column has the rows' entries
    one after the other, size their numbers. Counts are whole numbers: exact whatever the sizes."""
    row = np.repeat(np.arange(len(size)), size)
    right = 0 if left == len(size) else left
    out = np.zeros((left, len(size) - right), np.int32)
    many = np.bincount(column)
    rare, dense = (many >= 2) & (many < DENSE), np.flatnonzero(many >= DENSE)
    keep = rare[column]
    order = np.argsort(column[keep], kind="stable")
    c, r = column[keep][order], row[keep][order]
    for gap in range(1, DENSE - 1):  # entries of one column, gap places apart
        hit = c[gap:] == c[:-gap]
        x, y = r[:-gap][hit], r[gap:][hit]
        if right:
            cross = (x < left) & (y >= left)
            np.add.at(out, (x[cross], y[cross] - right), 1)
        else:
            np.add.at(out, (x, y), 1)
            np.add.at(out, (y, x), 1)
    where = np.full(len(many), -1)
    where[dense] = np.arange(len(dense))
    at = where[column]
    for lo in range(0, len(dense), 4096):
        own = (at >= lo) & (at < lo + 4096)
        m = np.zeros((len(size), min(4096, len(dense) - lo)), np.float32)
        m[row[own], at[own] - lo] = 1
        out += (m[:left] @ m[right:].T).astype(np.int32)  # up to 4096 in each chunk: exact in float32
    return out


def linked(both: np.ndarray, size: np.ndarray, left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose overlaps are at least num / den of their unions, by whole numbers; of one block, x < y."""
    right = 0 if left == len(size) else left
    total = size[:left, None] + size[None, right:]
    x, y = np.nonzero((den + num) * both.astype(np.int64) >= num * total)
    y = y + right
    return (x, y) if right else (x[x < y], y[x < y])


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, rows.num_rows, ROWS_OUT):
        yield rows.slice(i, ROWS_OUT)


def _signatures(width: int):
    """Of each text its size, two sums of hashes and the least of a third one, which near copies mostly share; and the
    n-grams (g, c) that are in LOCAL texts or more of some COUNTED bytes of text that follow one another."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def often() -> Iterator[pa.RecordBatch]:
            g = np.sort(np.concatenate(held)) if held else np.zeros(0, B.U)
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            c = np.diff(np.append(first, len(g)))
            g, c = g[first[c >= LOCAL]], c[c >= LOCAL]
            none = pa.nulls(len(g), pa.int64())
            yield from _slices(pa.RecordBatch.from_arrays([*[none] * 5, pa.array(g.view(np.int64)), pa.array(c)], names))

        names = ["id", "n", "h1", "h2", "low", "g", "c"]
        for b in batches:
            for i, j, data, at in B.text_batches(b.column(1), 1 << 20):
                grams, count = B.shingle_sets(data, at, width)
                h = np.zeros((3, j - i), B.U)
                has = count > 0
                if has.any():
                    starts = (np.cumsum(count) - count)[has]
                    with np.errstate(over="ignore"):
                        h[0][has] = np.add.reduceat(B.mixed(grams, 20), starts)
                        h[1][has] = np.add.reduceat(B.mixed(grams, 21), starts)
                        h[2][has] = np.minimum.reduceat(B.mixed(grams, 22), starts)
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(count), *[pa.array(x.view(np.int64)) for x in h], none, none], names)
                held.append(grams)
                size += len(data)
                if size >= COUNTED:
                    yield from often()
                    held, size = [], 0
        yield from often()

    return f


def common_grams(often: DataFrame) -> np.ndarray:
    """The n-grams (g, c) with the highest sums of c, MOST_COMMON at most, sorted. Any set is right; this one
    keeps blocks small. Numbers of n-grams by sum decide where to stop, so no more come to the driver."""
    sums = stored(often.groupBy("g").agg(F.sum("c").alias("c")), "jaccard-often")
    step = F.floor(F.log2("c") * 8).cast("int")
    left, least = MOST_COMMON, None
    for r in sorted(sums.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, B.U)
    found = sums.filter(step >= least).select("g").toArrow().column(0).to_numpy()
    return np.sort(found.view(B.U))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a and b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[once], b[once]


def _keys(width: int, num: int, den: int, common):
    """Keys of sets (key, id), but of sets that have a key in common in one task, up to HELD_KEYS at a time, only of
    the least id; the others are told as connected with it (key null, id, m). common: a broadcast of at most
    MOST_COMMON numbers."""

    def parts(x: np.ndarray) -> Iterator[np.ndarray]:
        lead = (x >> B.U(56)).astype(np.uint8) % KEY_PARTS
        for k in range(KEY_PARTS):
            yield np.flatnonzero(lead == k)

    def told(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Connections have keys of their own, so that they are dealt evenly."""
        return B.mixed(a.astype(B.U) ^ B.mixed(b.astype(B.U), 30), 31)

    def met(key: np.ndarray, id_: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = []
        for own in parts(key):
            k, i = key[own], id_[own]
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.append(True, k[1:] != k[:-1])[: len(k)]
            least = i[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            edges.append(_pairs(i[i != least], least[i != least]))
            yield from _slices(pa.RecordBatch.from_arrays([pa.array(k[new].view(np.int64)), pa.array(least[new]), pa.nulls(int(new.sum()), pa.int64())], names))
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        for own in parts(told(a, b)):
            x, y = _pairs(a[own], b[own])
            yield from _slices(pa.RecordBatch.from_arrays([pa.array(told(x, y).view(np.int64)), pa.array(x), pa.array(y)], names))

    names = ["key", "id", "m"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flat() -> list[np.ndarray]:
            out = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, at in B.text_batches(batch.column(1), 1 << 20):
                who, key = block_keys(*B.shingle_sets(data, at, width), num, den, common.value)
                if len(key):
                    held.append((key, ids[i:j][who]))
                    count += len(key)
                if count >= HELD_KEYS:
                    yield from met(*flat())
                    count = 0
        if held:
            yield from met(*flat())

    return f


def _found(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of linked rows a count of the documents they are linked with, and one connection."""
    links = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))
    root = B.roots(len(ids), x, y)
    has = np.flatnonzero(links)
    return {"id": ids[has], "links": links[has].astype(np.int64), "root": ids[root[has]]}


def _pack(ids: np.ndarray, weight: np.ndarray, grams: np.ndarray, size: np.ndarray) -> bytes:
    """A block of the incidence matrix, deflated: its distinct n-grams once, and each row's by their numbers."""
    u, at = np.unique(grams, return_inverse=True)
    parts = {"ids": ids, "weight": weight, "size": size, "u": u.view(np.int64), "at": at.astype(np.int32)}
    out = io.BytesIO()
    row = pa.record_batch({k: pa.ListArray.from_arrays(np.array([0, len(v)], np.int32), pa.array(v)) for k, v in parts.items()})
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(row)
    return out.getvalue()


def _unpack(block: bytes) -> dict[str, np.ndarray]:
    with pa.ipc.open_stream(block) as r:
        row = r.read_next_batch()
    return {k: row.column(k).flatten().to_numpy() for k in row.schema.names}


WORK = "id long, links long, root long, block long, level int, cut int, rows binary, keys array<long>"


def _sets(width: int, num: int, den: int, common):
    """Of a bin of small families its links; of a block of a large one (cut not null) the packed rows and their keys."""

    def f(group: pa.Table) -> pa.Table:
        ids, weight = group.column("id").to_numpy(), group.column("weight").to_numpy()
        parts = [B.shingle_sets(data, at, width) for _, _, data, at in B.text_batches(group.column("text"), 1 << 20)]
        grams, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        block, level, cut = (group.column(k)[0].as_py() for k in ("block", "level", "cut"))
        if cut is None:
            column = np.unique(grams, return_inverse=True)[1]
            told = _found(ids, weight, *linked(overlaps(column, size, len(size)), size, len(size), num, den))
            empty = {"block": pa.int64(), "level": pa.int32(), "cut": pa.int32(), "rows": pa.binary(), "keys": pa.list_(pa.int64())}
            return pa.table({**told, **{k: pa.nulls(len(told["id"]), t) for k, t in empty.items()}})
        none = {k: pa.nulls(1, pa.int64()) for k in ("id", "links", "root")}
        own = {"block": pa.array([block]), "level": pa.array([level], pa.int32()), "cut": pa.array([cut], pa.int32()), "rows": pa.array([_pack(ids, weight, grams, size)])}
        keys = [np.unique(block_keys(*x, num, den, common.value)[1]) for x in parts]  # by runs of rows: less is held at a time
        own["keys"] = pa.array([np.unique(np.concatenate(keys)).view(np.int64)], pa.list_(pa.int64()))
        return pa.table({**none, **own})

    return f


def _product(num: int, den: int):
    """Links between two blocks, or within one."""

    def f(pair: pa.Table) -> pa.Table:
        packs = [_unpack(x.as_py()) for x in pair.sort_by("side").column("rows")]
        both = {k: np.concatenate([p[k] for p in packs]) for k in ("ids", "weight", "size")}
        u, at = np.unique(np.concatenate([p["u"] for p in packs]), return_inverse=True)
        first = np.append(0, np.cumsum([len(p["u"]) for p in packs]))
        column = np.concatenate([at[o : o + len(p["u"])][p["at"]] for o, p in zip(first, packs, strict=False)])
        left, size = len(packs[0]["ids"]), both["size"]
        return pa.table(_found(both["ids"], both["weight"], *linked(overlaps(column, size, left), size, left, num, den)))

    return f


def meeting_packs(packs: DataFrame) -> DataFrame:
    """(block, x, y) of packs (block, level, cut, keys): each with itself, and pairs of one family, of the same or
    neighbouring levels, that have a key in common. Keys that the same packs share are one row before these become pairs."""
    at = packs.select("block", F.struct("level", "cut").alias("at"), "keys")
    shared = at.select("block", "at", F.explode("keys").alias("key")).groupBy("block", "key").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    shared = shared.filter(F.size("ats") > 1).select("block", "ats").distinct()
    pairs = shared.select("block", "ats", F.explode("ats").alias("x")).select("block", "x", F.explode("ats").alias("y"))
    pairs = pairs.filter((F.col("x") < F.col("y")) & (F.col("y.level") - F.col("x.level") <= 1)).distinct()
    return pairs.unionByName(at.select("block", F.col("at").alias("x"), F.col("at").alias("y")))


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """For each row: id_col, n_shingles, n_links, component_id. Exact: no link is missed, whatever the size.

    Two documents link if the Jaccard similarity of their sets of width-word shingles is at least num / den.
    n_links counts the other documents linked directly; component_id is the smallest id reached by links.

    1. Equal sets are one class (two 64-bit sums of hashes and the size), so copies cost one row each.
    2. n-grams that are in very many texts are counted, over all texts. block_keys gives keys, without these,
       that any two linked sets share. Sets of one task with a common key are connected there, so that a key has few
       rows, whatever its number of sets; then only the least id of a key is linked to the others, never all pairs.
       Connected sets are a family.
    3. Small families are put together. Of large ones, sets are dealt by level of size and a least hash, which near copies
       mostly share, to blocks of about block_rows rows and block_entries entries (where too many share it, by hash of the id);
       no set is linked beyond the next level. A block's rows are packed once: its texts do not move again.
    4. Each block with itself and each pair of blocks of one family, of levels next to each other, whose sets have a key in
       common (others have no link between them) is a sparse matrix product in one task, which adds up overlap counts of the
       whole sets and drops pairs below size-derived bounds. Links come back as a count and one connection
       for each row.

    Texts that are null or without words have empty sets and link with nothing; their component is their
    own id. A row with a null id links with nothing and has a null component. Ids are whole numbers (others are an
    error) and should be unique: rows that share one count as one vertex. Very long texts are read whole. An empty
    table gives no rows; other columns are not looked at, so their names do not clash. Runs jobs when called.
    """
    whole_ids(docs, id_col)
    with small_batches(docs.sparkSession):
        return _classes(docs, width, num, den, id_col, text_col, block_rows, block_entries)


def _classes(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, block_rows: int, block_entries: int) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = stored(own.mapInArrow(_signatures(width), "id long, n long, h1 long, h2 long, low long, g long, c long"), "jaccard-rows")
    rows = seen.filter("g is null").drop("g", "c")
    common = docs.sparkSession.sparkContext.broadcast(common_grams(seen.filter("g is not null").select("g", "c")))
    sets = ["n", "h1", "h2"]
    classes = rows.filter("id is not null and n > 0").groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.min("low").alias("low"))
    classes = stored(classes, "jaccard-classes")

    keys = own.filter("id is not null and text is not null").mapInArrow(_keys(width, num, den, common), "key long, id long, m long")
    least = F.min("id").over(Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = keys.withColumn("m", F.coalesce("m", least)).filter("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    families = components(near, "jaccard-near").withColumnRenamed("component", "block")

    members = stored(classes.join(families, F.col("rep") == F.col("id")).select("id", "n", "weight", "low", "block"), "jaccard-members")
    count, entries, most = members.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    levels = size_levels(most or 0, num, den).tolist()
    members = members.withColumn("level", F.size(F.filter(F.array(*map(F.lit, levels)), lambda x: x <= F.col("n"))).cast("int"))
    sizes = members.groupBy("block", "level").agg(F.count("*").alias("rows"), F.sum("n").alias("entries"))
    needed = lambda r, e: F.greatest(F.ceil(r / block_rows), F.ceil(e / block_entries)).cast("int")
    family = Window.partitionBy("block")  # a row for each level
    sizes = sizes.withColumn("small", needed(F.sum("rows").over(family), F.sum("entries").over(family)) == 1)
    sizes = stored(sizes.withColumn("cuts", needed(F.col("rows"), F.col("entries"))), "jaccard-sizes")
    bins = max(1, 2 * count // block_rows, 2 * (entries or 0) // block_entries)
    members = join_groups(members, sizes, ["block", "level"], "rows", count)
    large = stored(members.filter("not small").withColumn("near", F.pmod(F.xxhash64("low"), F.col("cuts"))), "jaccard-large")
    again = large.groupBy("block", "level", "near").agg(F.count("*").alias("own_rows"), needed(F.count("*"), F.sum("n")).alias("own_cuts"))
    large = join_groups(large, again, ["block", "level", "near"], "own_rows", count)
    large = large.withColumn("cut", (F.col("near") + F.col("cuts") * F.pmod(F.xxhash64("id"), F.col("own_cuts"))).cast("int"))
    few = members.filter("small").select("id", "weight", F.pmod(F.xxhash64("block"), F.lit(bins)).alias("block"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("cut"))
    dealt = few.unionByName(large.select("id", "weight", "block", "level", "cut"))
    texts = own.join(stored(dealt, "jaccard-dealt"), "id")
    work = stored(texts.groupBy("block", "level", "cut").applyInArrow(_sets(width, num, den, common), WORK), "jaccard-work")

    packs = work.filter("rows is not null").select("block", "level", "cut", "rows", "keys")
    pairs = meeting_packs(packs)
    ends = F.array_distinct(F.array("x", "y"))
    of = ["block", "x", "y"]
    sides = pairs.select(*of, F.posexplode(ends).alias("side", "end")).select(*of, "side", "end.level", "end.cut")
    products = packs.drop("keys").join(sides, ["block", "level", "cut"]).select(*of, "side", "rows")
    found = products.groupBy(*of).applyInArrow(_product(num, den), "id long, links long, root long")

    found = found.unionByName(work.filter("rows is null").select("id", "links", "root"))
    told = linked_classes(classes, found, "jaccard-found")
    told = stored(told.select(*sets, "weight", "n_links", "component"), "jaccard-told")
    valid = rows.filter("id is not null and n > 0")
    linked_rows = join_groups(valid, told, sets, "weight", rows.count()).select("id", "n", "n_links", "component")
    alone = rows.filter("id is null or n = 0").select("id", "n", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "n_links", F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one document of each component stays, the one with the smallest id.

    Rows with a null id stay, and so do those with null, empty or white texts. Of repeated rows all stay or none.
    Whole texts are compared, however long; ids are whole numbers. An empty table gives no rows. All columns are kept;
    work columns take names that docs does not have."""
    x = with_free_names(docs, ["gone"])["gone"]
    gone = jaccard_classes(docs, width, num, den, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(x)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(x), "left_anti")
