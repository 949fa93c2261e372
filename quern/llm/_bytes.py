"""Array code on a batch of texts as bytes: words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at a time.
CHUNK = 4 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mixed(np.arange(256, dtype=U), 1) | U(1)
_BASE = 0x2545F4914F6CDD1D


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(max(n, 1), U(_BASE))
        p[0] = 1
        return np.cumprod(p, dtype=U)


def text_batches(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of up to about most bytes (a longer text is a run of its own): first row, end row, the
    bytes, and each row's offset in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it is in. Words do not cross rows."""
    text = ~IS_SPACE[data]
    first = text.copy()
    first[1:] &= ~text[:-1]
    edge = at[:-1][at[:-1] < at[1:]]  # where a row with text begins
    first[edge] = text[edge]
    last = text.copy()
    last[:-1] &= ~text[1:]
    end = at[1:][at[:-1] < at[1:]] - 1
    last[end] = text[end]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int = CHUNK) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in pieces of up to about most bytes."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + most, "right")))
        size = stop[i:j] - start[i:j]
        own = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(own, size)
        read = data[np.repeat(start[i:j], size) + place]
        with np.errstate(over="ignore"):
            out[i:j] = np.add.reduceat(_BYTE[read] * powers(int(size.max()))[place], own)
            out[i:j] += size.astype(U) << U(56)
        i = j
    return mixed(out, 2)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the sorted distinct hashes of its word shingles, one row after the other, and their
    number in each row. A-Z count as lower case. With fewer words than width, all of them are one shingle."""
    data = LOWER[data]
    start, stop, row = word_spans(data, at)
    rows = len(at) - 1
    w = word_hashes(data, start, stop)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    parts, owners = [], []
    with np.errstate(over="ignore"):
        step = mixed(np.arange(width, dtype=U), 3) | U(1)
        if len(w) >= width:
            h = sum((w[i : len(w) - width + 1 + i] * step[i] for i in range(width)), U(0))
            full = row[: len(w) - width + 1] == row[width - 1 :]
            parts.append(mixed(h[full], width + 10))
            owners.append(row[: len(w) - width + 1][full])
        for n in range(1, width):
            own = np.flatnonzero(count == n)
            if len(own):
                parts.append(mixed(sum((w[first[own] + i] * step[i] for i in range(n)), U(0)), n + 10))
                owners.append(own)
    if not parts:
        return np.zeros(0, U), np.zeros(rows, np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    many = np.bincount(owner, minlength=rows)
    ends = np.cumsum(many)
    sets = [np.unique(h[e - n : e]) for e, n in zip(ends.tolist(), many.tolist(), strict=True)]
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.array([len(s) for s in sets], np.int64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For vertices 0 to n - 1 and edges (a, b), the least vertex of each one's component."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = np.minimum(root, root[root])
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def padded(data: np.ndarray, at: np.ndarray, before: int, after: int, value: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with so many bytes of value before and after each of them."""
    rows = len(at) - 1
    size = np.diff(at)
    to = at + np.arange(rows + 1) * (before + after)
    out = np.full(int(to[-1]), value, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(rows) * (before + after) + before, size)] = data
    return out, to


def byte_grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of order (up to 8) bytes within rows as numbers, first byte highest, and each one's row."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.zeros(n, U)
    for i in range(order):
        g = (g << U(8)) | data[i : n + i]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = row[:n] == row[order - 1 :]
    return g[whole], row[:n][whole]
