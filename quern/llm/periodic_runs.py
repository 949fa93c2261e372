"""Runs of words that repeat with a period, found by bit-parallel lags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has this many words at least, and this many of its periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Of texts of up to so many words every lag is compared; of longer ones those that lags_with_repeats leaves.
ALL_LAGS = 4096


def word_ids(text: bytes) -> tuple[list[bytes], list[int]]:
    """The words (runs of bytes but 0x20 and 0x09 to 0x0D) and a number for each different one."""
    words = text.split()
    numbers: dict[bytes, int] = {}
    return words, [numbers.setdefault(w, len(numbers)) for w in words]


def bit_planes(ids: list[int]) -> list[int]:
    """Big integers: bit i of plane k is bit k of the number of word i."""
    x = np.array(ids, np.int64)
    planes = max(int(x.max()).bit_length(), 1)
    return [int.from_bytes(np.packbits((x >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(planes)]


def matching_stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) of at least so many places i at which words i and i + lag are the same.

    A plane XORed with itself shifted by the lag has ones where its bit differs; ORed over the planes, where words do.
    Shift-doubling ANDs of the zeros leave places that a stretch of least zeros begins at; once none is left, further
    planes are not looked at."""
    every = (1 << (n - lag)) - 1
    differ = 0
    for p in planes:
        differ |= p ^ (p >> lag)
        begin, have = every & ~differ, 1
        while begin and have < least:
            step = min(have, least - have)
            begin &= begin >> step
            have += step
        if not begin:
            return []
    bits = np.unpackbits(np.frombuffer(begin.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    return [(int(a), int(b) + least - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def lags_with_repeats(ids: list[int]) -> list[int]:
    """Lags in order, among them the period of each run. A run of period q has at least 3 q words (24 if q is under 8),
    so with k words, k being 8 or the power of two from q to 2 q, some k words of it are there again q words later and,
    as k is no less than the smallest period, nowhere between: q is a distance of neighbouring equal k words. These are
    compared by hashes; a hash that two have in common only adds a lag."""
    x = np.array(ids, np.uint64)
    most, found = len(ids) // LEAST_PERIODS, set()
    with np.errstate(over="ignore"):
        h = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        k = 1
        while k // 2 < most and len(h):
            if k >= 8:
                order = np.argsort(h, kind="stable")
                gaps = np.diff(order)[h[order][1:] == h[order][:-1]]
                found.update(np.unique(gaps[(gaps <= min(k, most)) & ((gaps > k // 2) | (k == 8))]).tolist())
            h = h[: max(len(h) - k, 0)] * np.uint64(0xBF58476D1CE4E5B9) + (h[k:] ^ (h[k:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            k *= 2
    return sorted(found)


def runs_of(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    planes = bit_planes(ids)
    lags = range(1, n // LEAST_PERIODS + 1) if n <= ALL_LAGS else lags_with_repeats(ids)
    by_period: dict[int, list[tuple[int, int]]] = {}
    for q in lags:
        for start, end in matching_stretches(planes, n, q, max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)):
            end += q
            # Three periods long: a smaller period of the whole stretch divides q, and is that of a run found before.
            if not any(q % p == 0 and any(a <= start and end <= b for a, b in spans) for p, spans in by_period.items()):
                by_period.setdefault(q, []).append((start, end))
    return sorted((a, b - a, p) for p, spans in by_period.items() for a, b in spans)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, a space between."""
    if not runs:
        return b" ".join(words)
    over = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        over[start + period] += 1
        over[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(over[:-1]) == 0).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first in range(0, b.num_rows, 512):  # so that what is held of texts is bounded
            rows = b.slice(first, 512)
            n, runs, kept = [], [], []
            for text in rows.column(1).cast(pa.large_binary()):
                words, ids = word_ids(text.as_py() or b"")
                found = runs_of(ids)
                n.append(len(words))
                runs.append([dict(start=s, length=m, period=p) for s, m, p in found])
                kept.append(collapsed(words, found))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(runs, RUNS), kept], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, runs (start, length, period; by start, then period) and collapsed of each row of docs.

    A run is a stretch of consecutive words with smallest period q, of at least LEAST_WORDS words and LEAST_PERIODS
    periods, that no neighbouring word extends keeping the period. collapsed has the words, a space between, that no
    run holds after its first period. There is no shuffle: each text is worked on by itself, as big integers with a
    bit for each word; the time goes with lags times words, the memory with the words. Of texts of over ALL_LAGS words
    only those lags are compared that some words are repeated at, which misses none that a run could have.

    Null, empty and white texts have no words, no runs and an empty collapsed text. Very long texts are read whole,
    repeated rows each, rows with a null id like others; an empty table gives no rows. Other columns are not looked at.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_found, schema).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """Of runs in order, the first with the greatest length / period, compared exactly."""
    over = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(over(r, best), r).otherwise(best))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, of which about each tenth has a text that is periodic from some word on: with h the CRC-32 of the id in
    decimal and g = h // 10, if h % 10 is 0 and there are words, each word i from a = g % n on is
    word a + (i - a) % (1 + (n - a) // (3 + g % 8)). Null ids' and other texts stay as they are."""
    h = F.crc32(F.col(id_col).cast("string"))
    text = F.col(text_col)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    with_words = F.struct(words.alias("w"), F.floor(h / 10).alias("g"))

    def planted(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        return F.array_join(F.transform(x["w"], lambda w, i: F.when(i < a, w).otherwise(F.get(x["w"], (a + (i - a) % p).cast("int")))), " ")

    new = F.get(F.transform(F.array(with_words), planted), F.lit(0))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), new).otherwise(text))
