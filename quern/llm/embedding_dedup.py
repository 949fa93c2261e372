"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import join_groups, linked_classes, stored, whole_ids

#: Leading principal dimensions that are kept for the grid and the bounding boxes.
DIMENSIONS = 12
#: Numbers of the vectors that the axes are fitted on: rows x dimensions, at most.
SAMPLE_NUMBERS = 1 << 20
#: Bytes of a block of the sequence, blocks that there should be at least, and rows below which an interval is not
#: cut further.
BLOCK_BYTES, LEAST_BLOCKS, LEAF = 1 << 20, 12, 512
#: Bytes of the blocks that a task multiplies with as many others.
TILE_BYTES = 64 << 20
#: Blocks, and then intervals of blocks, that make an interval of the next level.
FAN = 8


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; scaled first, so that squares neither overflow nor vanish."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def principal(vectors: DataFrame, d: int, leading: int = DIMENSIONS, numbers: int = SAMPLE_NUMBERS) -> np.ndarray:
    """The leading principal axes of a sample: the numbers // d vectors (at least leading + 1) whose ids have the least
    hashes, so the same ones each time. Any axes are right; these make the boxes small."""
    rows = max(numbers // d, leading + 1)
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("v").toArrow().column(0)
    x = unit(_matrix(sample.combine_chunks(), d))
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:leading]
    # Fewer vectors than axes: any axes at right angles to these.
    return np.linalg.qr(np.vstack([axes, np.eye(d)]).T)[0][:, :leading].copy()


def _cells(axes: np.ndarray, eps: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.floor(unit(_matrix(b.column("v"), len(axes))) @ axes / eps).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * cell.shape[1]), pa.array(cell.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("weight"), b.column("v"), cells], ["rep", "weight", "v", "cell"])

    return f


def _blocks(axes: np.ndarray, rows: int):
    """Cut a task's sorted rows into blocks with their bounding boxes in the leading dimensions."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block(x: pa.Table) -> pa.RecordBatch:
            m = np.ascontiguousarray(_matrix(x.column("v").combine_chunks(), len(axes)))
            at = unit(m) @ axes
            as_list = lambda y: pa.array([y.tolist()], pa.list_(pa.float64()))
            ids, weights = (x.column(k).to_numpy().astype(np.int64).tobytes() for k in ("rep", "weight"))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), as_list(at.min(0)), as_list(at.max(0)), pa.array([ids]), pa.array([weights]), pa.array([m.tobytes()])], ["part", "n", "lo", "hi", "reps", "weights", "data"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= 4 * rows:  # a task should have one block's rows; of more, not all are held
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, rows))
                n, held, count = n + 1, t.slice(rows).to_batches(), count - rows
        if count:
            t = pa.Table.from_batches(held)
            ends = np.linspace(0, count, max(1, round(count / rows)) + 1).astype(int).tolist()
            for i, j in zip(ends, ends[1:], strict=False):  # equal ones, so that no small rest meets all others
                yield block(t.slice(i, j - i))
                n += 1

    return f


def meeting_blocks(boxes: DataFrame, far: float, fan: int = FAN) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, whose boxes (id, lo, hi; id: place in the sequence) are not provably more than
    the square root of far apart.

    The sequence is joined with itself recursively: fan blocks that follow one another are an interval, with the box
    around theirs, fan intervals one of the next level, up to a single one. From there down, a pair of intervals
    that are not distant becomes the pairs of their parts, and distant ones are skipped with all that is in them. Each
    level is a join on the interval, dealt over all tasks; no pair is looked at whose intervals are distant."""
    levels = [boxes]
    count, dims = boxes.agg(F.count("*"), F.max(F.size("lo"))).first()
    ends = lambda k, f: F.array(*[f(F.col(k)[i]) for i in range(dims)]).alias(k)
    while count > 1:
        up = levels[-1].groupBy(F.floor(F.col("id") / fan).cast("long").alias("id")).agg(ends("lo", F.min), ends("hi", F.max))
        levels.append(stored(up, "ego-boxes"))
        count = -(-count // fan)
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for x in levels[-2::-1]:
        part = lambda side: x.select(F.floor(F.col("id") / fan).cast("long").alias(side), *[F.col(k).alias(f"{side}_{k}") for k in x.columns])  # noqa: B023, E731
        apart = F.zip_with(F.zip_with("a_lo", "b_hi", lambda p, q: p - q), F.zip_with("b_lo", "a_hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
        near = F.aggregate(apart, F.lit(0.0), lambda s, g: s + g * g) <= far
        down = pairs.join(part("a"), "a").join(part("b"), "b").filter("a_id <= b_id").filter(near)
        pairs = stored(down.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "ego-pairs")
    return pairs


def join_intervals(x: np.ndarray, y: np.ndarray, axes: np.ndarray, cosine: float, same: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of x and y (unit vectors, in grid order) with a cosine of at least cosine; with
    same, x is y and i < j. Intervals are halved until they are short, and left out once their bounding
    boxes are more than the distance apart that the cosine stands for."""
    far = 2 - 2 * cosine + 1e-9
    px, py = x @ axes, y @ axes
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (k, a, b) not in boxes:
            p = (py if k else px)[a:b]
            boxes[k, a, b] = p.min(0), p.max(0)
        return boxes[k, a, b]

    found = []
    # Products are screened in single precision, with room for its rounding, and decided in double precision.
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    least = np.float32(cosine - (x.shape[1] + 16) * 2.0**-23)
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if same and d <= a:
            continue
        (lo, hi), (low, high) = box(0, a, b), box(0 if same else 1, c, d)
        gap = np.maximum(0, np.maximum(lo - high, low - hi))
        if gap @ gap > far:
            continue
        if b - a <= leaf and d - c <= leaf:
            hit = np.flatnonzero(fx[a:b] @ fy[c:d].T >= least)
            i, j = hit // (d - c) + a, hit % (d - c) + c
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                good = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
                found.append((p[good], q[good]))
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def tiles(pairs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of blocks with their tile (ta, tb), of width by width blocks, and the blocks (ta, tb, id) that each
    tile needs. A block is sent once to a tile, however many pairs of the tile it is in, and not to tiles without pairs."""
    of = lambda k: F.floor(F.col(k) / width).cast("long").alias(f"t{k}")
    placed = pairs.select(of("a"), of("b"), "a", "b")
    return placed, placed.select("ta", "tb", F.explode(F.array("a", "b")).alias("id")).distinct()


def tile_width(blocks: int, block_bytes: int, most: int = TILE_BYTES) -> int:
    """The blocks on a side of a tile: the square root of their number, so that sends grow with its power 1.5, as far as a
    task holds as much."""
    return max(1, min(int(np.sqrt(blocks)), most // max(block_bytes, 1)))


def _join(axes: np.ndarray, cosine: float, kind: str):
    """Links within a tile, whose vectors' components are of kind: of each linked vector a count and one connection."""

    def f(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        read = lambda k, of: [np.frombuffer(v.as_py(), of) for v in blocks.column(k)]
        place = {b: k for k, b in enumerate(blocks.column("id").to_pylist())}
        reps, weights = read("reps", np.int64), read("weights", np.int64)
        m = [unit(v.reshape(-1, len(axes))) for v in read("data", kind)]
        first = np.append(0, np.cumsum([len(r) for r in reps]))
        ids, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (reps, weights))
        links, found = np.zeros(len(ids)), []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            p, q = place[a], place[b]
            i, j = join_intervals(m[p], m[q], axes, cosine, p == q)
            for k, own, other, x in ((p, i, j, weights[q]), (q, j, i, weights[p])):
                links[first[k] : first[k + 1]] += np.bincount(own, x[other], len(reps[k]))
            if len(i):  # a connection for each vector is enough of each pair of blocks
                at = np.arange(first[p], first[p + 1]) if p == q else np.append(np.arange(first[p], first[p + 1]), np.arange(first[q], first[q + 1]))
                root = B.roots(len(at), i, j if p == q else j + len(reps[p]))
                has = np.flatnonzero(root != np.arange(len(at)))
                found.append((at[has], at[root[has]]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        root = B.roots(len(ids), i, j)
        has = np.flatnonzero(links)
        return pa.table({"id": ids[has], "links": links[has].astype(np.int64), "root": ids[root[has]]})

    return f


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """One row for each vector: id_col, n_links, component_id, kept. Exact, in double precision.

    Vectors link if their cosine is at least cosine (over 0). For unit vectors this is a distance, eps.
    Equal vectors are one row with a weight. The others are sorted by their cells, of width eps, on the
    leading principal dimensions (epsilon grid order; the axes are fitted on a sample of SAMPLE_NUMBERS numbers), range
    by range over all tasks, and cut into blocks of up to block_bytes. meeting_blocks joins intervals of the
    sequence of blocks recursively, skipping provably distant ones; join_intervals goes on in the same way within two
    blocks, so only short intervals are multiplied. Pairs of blocks are put together in tiles, of which each gets a block
    at most once, and a task for each returns a count and a connection for each vector, not pairs.

    What is skipped depends on the vectors: if the leading dimensions keep them apart, most blocks; if they spread
    evenly in very many dimensions, no boxes are distant and the work is that of all pairs of blocks.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are
    their own component; so does a null id, with a null component. Vectors of different lengths do not
    link. Ids are whole numbers (others are an error) and should be unique: rows that share one count as one vertex. An
    empty table gives no rows; other columns, labels included, are not looked at. Runs jobs when called.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0, up to 1")
    whole_ids(vectors, id_col)
    eps = float(np.sqrt(2 - 2 * cosine)) or 1e-3
    far = 2 - 2 * cosine + 1e-9
    v = F.col(vector_col)
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    v = v if single else v.cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    classes = rows.filter("good").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("d", F.size("v")), "ego-classes")
    found = None
    for d, n in [tuple(r) for r in classes.groupBy("d").count().collect()]:
        own = classes.filter(F.col("d") == d).select("rep", "weight", "v")
        axes = principal(own, d, min(d, DIMENSIONS))
        size = max(min(-(-n // LEAST_BLOCKS), block_bytes // ((4 if single else 8) * d)), min(LEAF, n))
        cells = own.mapInArrow(_cells(axes, eps), own.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", cell array<int>")
        parts = max(1, round(n / size))
        ordered = cells.repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep")
        blocks = ordered.drop("cell").mapInArrow(_blocks(axes, size), "part long, n long, lo array<double>, hi array<double>, reps binary, weights binary, data binary")
        blocks = stored(blocks, "ego-blocks")
        # A block's place in the sequence: its place in the task, after the blocks of the tasks before.
        tasks = blocks.groupBy("part").agg(F.count("*").alias("many"))
        tasks = tasks.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))
        placed = blocks.join(F.broadcast(tasks), "part").withColumn("id", F.col("before") + F.col("n"))
        boxes = stored(placed.select("id", "lo", "hi"), "ego-boxes")
        pairs = meeting_blocks(boxes, far, fan)
        width = tile_width(boxes.count(), size * (4 if single else 8) * d)
        pairs, sides = tiles(pairs, width)
        sent = placed.select("id", "reps", "weights", "data").join(sides.withColumnsRenamed({"ta": "va", "tb": "vb"}), "id")
        part = sent.groupBy("va", "vb").cogroup(pairs.groupBy("ta", "tb")).applyInArrow(_join(axes, cosine, "f4" if single else "f8"), "id long, links long, root long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, root long")
    told = linked_classes(classes.select("rep", "weight"), found, "ego-found")
    told = stored(told.select("rep", "n_links", "component"), "ego-told")
    rep = classes.select("v", "rep", "weight").join(told, "rep").drop("rep")
    linked = join_groups(rows.filter("good").select("id", "v"), rep, ["v"], "weight", max(vectors.count(), 1)).select("id", "n_links", "component")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
