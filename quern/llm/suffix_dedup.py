"""Repeated byte strings: suffixes at anchors, dealt by anchor, sorted, and extended backwards (as a BWT does)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._blocks import ROW, each, pack, texts, unpack
from ._shared import join_groups, stored, whole_ids

#: Bytes of a repeated string, and of an anchor within it.
LENGTH = 100
ANCHOR = 32
#: Suffixes that one task sorts, on average.
SHARD_ROWS = 60_000
#: Strings of anchors that are there more often are dealt by string, not by anchor; as many of their rows
#: (up to LENGTH - ANCHOR + 1 strings of an anchor, without text) as one suffix is counted for.
HOT_ROWS, HOT_WEIGHT = 60_000, 16
#: Window starts that are looked at together.
PIECE = 1 << 24


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR (a power of two) bytes from each place on."""
    h, n = B._BYTE[data], 1
    with np.errstate(over="ignore"):
        while n < ANCHOR:
            if len(h) <= n:
                return np.zeros(0, B.U)
            h = B.mixed(h[:-n] * B.U(0xD6E8FEB86659FD93) + h[n:], n) if n > 4 else h[:-n] * B.U(0xD6E8FEB86659FD93 + 2 * n) + h[n:]
            n *= 2
    return h


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each string of LENGTH bytes within a row has an anchor: of its ANCHOR-byte pieces the one with the least
    hash, the first of equal ones; equal strings have it at the same place. Runs of strings with one anchor:
    key (a hash of its bytes), place, first and last start of the strings, and row."""
    found = []
    for s in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        part = data[s : s + PIECE + LENGTH - 1]
        h = anchor_hashes(part)
        low = ((h >> B.U(32)) << B.U(32)) | np.arange(len(h), dtype=B.U)
        width, w = LENGTH - ANCHOR + 1, 1
        while 2 * w <= width:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if width > w:
            low = np.minimum(low[: len(low) - (width - w)], low[width - w :])
        place = (low & B.U(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(len(place))
        row = np.searchsorted(at, start + s, "right") - 1
        whole = start + s + LENGTH <= at[row + 1]
        place, start, row = place[whole], start[whole], row[whole]
        if not len(place):
            continue
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])))
        last = np.append(new[1:], len(place)) - 1
        found.append((B.mixed(h[place[new]], 50), place[new] + s, start[new] + s, start[last] + s, row[new]))
    if not found:
        return (np.zeros(0, B.U), *[np.zeros(0, np.int64)] * 4)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of LENGTH bytes or more: row, id, SHA-256."""
    import hashlib

    for b in batches:
        for block, rows in zip(b.column(0), b.column(1), strict=True):
            first, out = block.as_py() * ROW, {"row": [], "id": [], "sha": []}
            for x in unpack(rows.as_py()):
                ids = x.column(0).to_pylist()
                for i, _, data, at in texts(x, "text"):
                    for k in np.flatnonzero(np.diff(at) >= LENGTH).tolist():
                        out["row"].append(first + i + k)
                        out["id"].append(ids[i + k])
                        out["sha"].append(hashlib.sha256(data[at[k] : at[k + 1]]).digest())
                first += x.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["sha"], pa.binary())], ["row", "id", "sha"])


def _new_texts(blocks: pa.Table, copies: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, row numbers and ids of the blocks' texts; texts in copies are left empty."""
    for block, rows in each(blocks):
        first = block * ROW
        for x in unpack(rows):
            ids = x.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            for i, j, data, at in texts(x, "text"):
                row = np.arange(first + i, first + j)
                gone = np.isin(row, copies)
                if gone.any():
                    size = np.where(gone, 0, np.diff(at))
                    data = data[np.repeat(~gone, np.diff(at))]
                    at = np.append(0, np.cumsum(size))
                yield data, at, row, ids[i:j]
            first += x.num_rows


def _keys(blocks: pa.Table, copies: pa.Table) -> pa.Table:
    """The distinct anchors of a block, and how often they are there."""
    gone = copies.column("row").to_numpy()
    keys = [anchors(data, at)[0] for data, at, _, _ in _new_texts(blocks, gone)]
    key, many = np.unique(np.concatenate(keys) if keys else np.zeros(0, B.U), return_counts=True)
    block = blocks.column("block")[0].as_py() if blocks.num_rows else 0
    return pa.table({"key": key.view(np.int64), "block": np.full(len(key), block), "c": many})


def _suffixes(shards: int):
    """Of a block's repeated anchors: their surroundings, as far as strings with that anchor reach.

    Of equal surroundings in a block only the first is sent; the strings of the others start later than
    equal ones and are told as spans (text null, place and reach: first byte and end). Of hot anchors the
    strings are sent, once for equal ones (text null; key and reach: 128-bit hash), dealt by their hash."""

    def f(key: tuple, blocks: pa.Table, asked: pa.Table) -> pa.Table:
        gone = asked.filter(pa.compute.is_valid(asked.column("row"))).column("row").to_numpy()
        asked = asked.filter(pa.compute.is_valid(asked.column("key")))
        wanted = np.sort(asked.column("key").to_numpy().view(B.U))
        often = asked.filter(asked.column("hot")).column("key").to_numpy().view(B.U)
        held = []
        side = LENGTH - ANCHOR
        for data, at, rows, ids in _new_texts(blocks, gone):
            key, place, lo, hi, row = anchors(data, at)
            if not len(key) or not len(wanted):
                continue
            hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            key, place, lo, hi, row = key[hit], place[hit], lo[hit], hi[hit], row[hit]
            spot = place[:, None] + np.arange(-side, LENGTH)
            inside = (spot >= lo[:, None]) & (spot < hi[:, None] + LENGTH)
            around = np.where(inside, data[np.clip(spot, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
            held.append((key, ids[row], rows[row], place - at[row], place - hi, place - lo, around))
        names = ["shard", "key", "id", "row", "place", "reach", "near", "far", "text"]
        kinds = [pa.int64(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()]
        if not held:
            return pa.table([pa.array([], k) for k in kinds], names)
        key, id_, row, place, near, far, around = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, row, id_))
        key, id_, row, place, near, far, around = (x[order] for x in (key, id_, row, place, near, far, around))
        words = np.zeros((len(key), (around.shape[1] + 9) // 8 * 8), np.uint8)
        words[:, : around.shape[1]] = around
        words[:, -2], words[:, -1] = near, far
        words = words.view(B.U)
        with np.errstate(over="ignore"):
            print_ = np.zeros(len(key), B.U)
            for i in range(words.shape[1]):
                print_ = B.mixed(print_ * B.U(31) + words[:, i], 51)
        _, lead, which = np.unique(print_, return_index=True, return_inverse=True)
        lead = lead[which]
        again = (lead != np.arange(len(key))) & (words == words[lead]).all(1)
        new = np.flatnonzero(~again)
        hot = np.isin(key[new], often)
        hot, new = new[hot], new[~hot]
        side_cols = np.arange(-side, LENGTH)
        used = (side_cols >= -far[new][:, None]) & (side_cols < LENGTH - near[new][:, None])
        flat, size = around[new][used], used.sum(1)
        ends = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32))
        sent = pa.Array.from_buffers(pa.binary(), len(new), [None, ends, pa.py_buffer(np.ascontiguousarray(flat))])
        shard = (key[new] % B.U(shards)).astype(np.int64)
        first = pa.table([pa.array(shard), pa.array(key[new].view(np.int64)), pa.array(id_[new]), pa.array(row[new]), pa.array(place[new]), pa.nulls(len(new), pa.int64()), pa.array(near[new], pa.int32()), pa.array(far[new], pa.int32()), sent], names)
        parts, r, s, e = [first], [row[again]], [(place - far)[again]], [(place - near)[again] + LENGTH]
        for a in range(side + 1):  # equal strings have their anchor at the same place
            on = hot[(near[hot] <= a) & (a <= far[hot])]
            if len(on):
                digest, lead = _distinct_strings(around[on, side - a : side - a + LENGTH])
                m, start = int(lead.sum()), place[on] - a
                part = (digest[lead, 0].view(B.U) % B.U(shards)).astype(np.int64)
                part = [part, digest[lead, 0], id_[on[lead]], row[on[lead]], start[lead], digest[lead, 1]]
                parts.append(pa.table([*map(pa.array, part), *[pa.nulls(m, k) for k in kinds[6:]]], names))
                r, s, e = [*r, row[on[~lead]]], [*s, start[~lead]], [*e, start[~lead] + LENGTH]
        # Spans of one row that touch are one.
        r, s, e = joined(*(np.concatenate(x) for x in (r, s, e)))
        n = len(r)
        told = pa.table([pa.array(r % shards), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(r), pa.array(s), pa.array(e), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        return pa.concat_tables([*parts, told])

    return f


def _distinct_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of strings (rows of bytes), and which of them are the first of equal ones."""
    from hashlib import blake2b

    strings = np.ascontiguousarray(strings)
    digest = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in strings), np.int64).reshape(-1, 2)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    lead = np.ones(len(digest), bool)
    lead[order[1:][(digest[order[1:]] == digest[order[:-1]]).all(1)]] = False
    return digest, lead


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, by row: those that overlap or touch become one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    rank = np.cumsum(np.append(0, row[1:] != row[:-1]))
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * top) - rank * top
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])))
    return row[new], start[new], reach[np.append(new[1:], len(row)) - 1]


def later_strings(key: np.ndarray, rank: np.ndarray, near: np.ndarray, far: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, a): the string that starts a bytes before anchor i is equal to one that starts earlier.

    around has LENGTH - ANCHOR bytes before each anchor and LENGTH from it on; strings with a from near to far
    are inside. rank says which anchors come earlier.

    Suffixes that start at the anchors are sorted first, byte by byte from the last, by stable sorts (blocks send no
    sorted runs: this takes the place of a merge of these); where neighbours first differ is their
    common prefix. Then all suffixes move one byte to the left at a time: sorting the interleave by the bytes
    in front of them (their Burrows-Wheeler column), stably, is the order of the longer suffixes, with no
    suffix compared again. An interval whose members share the bytes on the left, and on the right a
    common prefix that makes LENGTH bytes, is a repeated string.
    """
    side = LENGTH - ANCHOR
    n = len(key)
    right = around[:, side + ANCHOR :]
    z = np.arange(n)
    for c in range(side - 1, -1, -1):
        z = z[np.argsort(right[z, c], kind="stable")]
    for c in range(side + ANCHOR - 1, side - 1, -1):
        z = z[np.argsort(around[z, c], kind="stable")]
    r = right[z]
    differ = r[1:] != r[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), side)
    prefix[(around[z[1:], side : side + ANCHOR] != around[z[:-1], side : side + ANCHOR]).any(1)] = -1
    merged, left = z, np.zeros(n, np.int64)
    which, how = [], []
    for a in range(side + 1):
        if a:
            c = around[z, side - a]
            by = np.argsort(c, kind="stable")
            z, c, left = z[by], c[by], left[by]
            left = np.append(0, np.cumsum((c[1:] != c[:-1]) | (left[1:] != left[:-1]))) if n else left
        same = np.empty(n, np.int64)
        same[merged] = np.append(0, np.cumsum(prefix < side - a)) if n else same
        on = (near[z] <= a) & (a <= far[z])
        own = z[on]
        if not len(own):
            continue
        x, y = left[on], same[own]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        least = np.repeat(np.minimum.reduceat(rank[own], first), np.diff(np.append(first, len(own))))
        later = own[rank[own] > least]
        which.append(later)
        how.append(np.full(len(later), a))
    return (np.concatenate(which), np.concatenate(how)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merge(group: pa.Table) -> pa.Table:
    told = group.filter(pa.compute.is_null(group.column("text")))
    spans = told.filter(pa.compute.is_null(told.column("key")))
    hot = told.filter(pa.compute.is_valid(told.column("key")))
    rows = group.filter(pa.compute.is_valid(group.column("text")))
    read = lambda t, k: t.column(k).to_numpy()
    row, start, end = read(spans, "row"), read(spans, "place"), read(spans, "reach")
    if rows.num_rows:
        key, id_, r, place, near, far = (read(rows, k) for k in ("key", "id", "row", "place", "near", "far"))
        side = LENGTH - ANCHOR
        cols = np.arange(-side, LENGTH)
        used = (cols >= -far[:, None]) & (cols < LENGTH - near[:, None])
        around = np.zeros(used.shape, np.uint8)
        around[used] = np.frombuffer(b"".join(rows.column("text").to_pylist()), np.uint8)
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((place, r, id_))] = np.arange(len(key))
        i, a = later_strings(key, rank, near, far, around)
        row, start, end = np.append(row, r[i]), np.append(start, place[i] - a), np.append(end, place[i] - a + LENGTH)
    if hot.num_rows:
        key, hash_, id_, r, place = (read(hot, k) for k in ("key", "reach", "id", "row", "place"))
        order = np.lexsort((place, r, id_, hash_, key))
        later = order[1:][(key[order[1:]] == key[order[:-1]]) & (hash_[order[1:]] == hash_[order[:-1]])]
        row, start, end = np.append(row, r[later]), np.append(start, place[later]), np.append(end, place[later] + LENGTH)
    row, start, end = joined(row.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    return pa.table({"block": row // ROW, "row": row, "start": start, "end": end})


def _cut(blocks: pa.Table, spans: pa.Table) -> pa.Table:
    """Each row's spans and the bytes left."""
    row, start, end = joined(*(spans.column(k).to_numpy() for k in ("row", "start", "end")))
    out: dict[str, list] = {"id": [], "n_bytes": [], "spans": [], "kept": []}
    for block, rows in each(blocks):
        first = block * ROW
        for x in unpack(rows):
            out["id"] += x.column(0).to_pylist()
            for i, j, data, at in texts(x, "text"):
                a, b = np.searchsorted(row, [first + i, first + j])
                own = row[a:b] - first - i
                s, e = at[own] + start[a:b], at[own] + end[a:b]
                left = np.zeros(len(data) + 1, np.int32)
                np.add.at(left, s, 1)
                np.add.at(left, np.minimum(e, at[own + 1]), -1)
                left = np.cumsum(left[:-1]) == 0
                many = np.bincount(own, minlength=j - i)
                kept = data[left].tobytes()
                ends = np.append(0, np.cumsum(left))[at]
                where = np.append(0, np.cumsum(many))
                whole = [{"start": int(p), "end": int(q)} for p, q in zip(start[a:b], end[a:b], strict=True)]
                for k in range(j - i):
                    out["n_bytes"].append(int(at[k + 1] - at[k]))
                    out["spans"].append(whole[where[k] : where[k + 1]])
                    out["kept"].append(kept[ends[k] : ends[k + 1]])
            first += x.num_rows
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(out["id"], pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept"], pa.binary())], ["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, spans (maximal removed runs, start and end), kept (bytes).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a row with a smaller id
    (null last; of equal ids, the row read first), or earlier in the same row. All strings of the input
    count, whatever is removed. Strings do not cross rows. Null text is empty; texts under LENGTH bytes stay
    whole; very long ones are read whole. Ids are whole numbers; others are an error. An empty table gives no rows; other
    columns are not looked at, so their names do not clash. Runs jobs when called.

    1. Texts are packed in blocks. Texts equal to an earlier one go whole, and need no more work.
    2. Each string has an anchor, its piece with the least hash, so equal strings have equal anchors, and only
       anchors that are there twice can be in repeated strings. Blocks ask which of theirs are.
    3. The surroundings of these anchors (once for equal ones in a block) are dealt to shards by anchor, where
       later_strings finds equal strings. Of anchors that are there more than HOT_ROWS times each block sends the distinct
       strings' hashes and first places instead, dealt by hash: a string has a row for each block at most.
    4. Spans go back to the blocks.
    """
    whole_ids(docs, id_col)
    blocks = pack(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text")
    whole = stored(blocks.mapInArrow(_texts, "row long, id long, sha binary"), "repeat-texts")
    firsts = whole.groupBy("sha").agg(F.count("*").alias("c"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).filter("c > 1")
    copies = join_groups(whole, firsts, ["sha"], "c", whole.count()).filter("row <> best.row").select(F.floor(F.col("row") / ROW).cast("long").alias("block"), "row")
    copies = stored(copies, "repeat-copies")

    keys = stored(blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(_keys, "key long, block long, c long"), "repeat-anchors")
    twice = keys.groupBy("key").agg(F.sum("c").alias("all")).filter("all > 1").select("key", (F.col("all") > HOT_ROWS).alias("hot"))
    keys = stored(keys.join(twice, "key").select("key", "block", "c", "hot"), "repeat-keys")
    rows = F.col("c") * F.when(F.col("hot"), HOT_WEIGHT).otherwise(1)
    shards = max(1, -(-(keys.agg(F.sum(rows)).first()[0] or 0) // SHARD_ROWS))
    none = F.lit(None).cast("long")
    asked = keys.select("block", "key", none.alias("row"), "hot").unionByName(copies.select("block", none.alias("key"), "row", F.lit(False).alias("hot")))
    schema = "shard long, key long, id long, row long, place long, reach long, near int, far int, text binary"
    suffixes = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_suffixes(shards), schema)
    spans = suffixes.groupBy("shard").applyInArrow(_merge, "block long, row long, start long, end long")
    size = F.lit(1 << 40)  # a copy goes whole; its end is cut to its length
    spans = spans.unionByName(copies.select("block", "row", F.lit(0).cast("long").alias("start"), size.cast("long").alias("end")))
    spans = stored(spans, "repeat-spans")
    cut = blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut, "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], F.col("n_bytes")).alias("end")))
    return cut.select(F.col("id").alias(id_col), "n_bytes", spans.alias("spans"), "kept")
