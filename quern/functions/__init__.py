"""Column functions on text and keys."""

from __future__ import annotations

import json
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The maximal runs of Unicode letters, in order. Case counts; digits, marks and all else separate."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def split_lines(text: Column) -> Column:
    """The lines that are not empty; only line feeds end a line."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def sort_key(line: Column) -> Column:
    """What stands before the first two spaces in a row, or the whole line if there are none."""
    return F.substring_index(line, "  ", 1)


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of the key's UTF-8 bytes, without the sign bit."""
    # Fixed values of the hash: offset basis 2166136261, prime 16777619.
    octets = F.regexp_extract_all(F.hex(F.encode(key, "UTF-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.aggregate(octets, F.lit(2166136261).cast("bigint"), step).bitwiseAND(F.lit(2147483647).cast("bigint"))


def hash_partition(key: Column, n: int) -> Column:
    _at_least_one(n)
    return fnv1a(key) % n


def sorted_literal(points: list, kind: str) -> Column:
    """A sorted list as one literal of the plan (Spark evaluates it once), however many points it has."""
    return F.from_json(F.lit(json.dumps(points)), f"array<{kind}>")


def place_among(points: Column, n: int, probe: Column, after_equals: bool = False, first: Column | None = None, end: Column | None = None, widest: int | None = None) -> Column:
    """How many of n sorted points are below the probe (with after_equals: not above it), found by halves: as many
    comparisons as n has bits. first and end say between which points it must be, widest how far these are apart."""
    start = F.lit(0) if first is None else first
    stop = F.lit(n) if end is None else end
    steps = [1 << k for k in range((n if widest is None else widest).bit_length() - 1, -1, -1)]

    def further(at: Column, step: Column) -> Column:
        point = F.get(points, (at + step - 1).cast("int"))
        return F.when((at + step <= stop) & (point <= probe if after_equals else point < probe), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)).cast("array<int>"), start.cast("int"), further).cast("bigint")


def splits_below(key: Column, splits: list[str]) -> Column:
    """How many of the split points are below the key, bytewise: the number of the range it is in; 0 for null.

    The points are a sorted array with the place of the first point of each leading byte (all beyond ASCII are one), so that
    a key is compared only with points of its own leading byte, and of these by halves."""
    points = sorted(splits, key=str.encode)
    # Of each leading byte up to 128, how many points have a lower one; the empty point is below all.
    heads = [min(p.encode()[0], 128) if p else -1 for p in points]
    starts = [bisect_left(heads, b) for b in range(129)] + [len(points)]
    lead = F.least(F.ascii(key), F.lit(128))
    widest = max((b - a for a, b in zip(starts, starts[1:], strict=False)), default=0)
    bounds = F.array(*map(F.lit, starts)).cast("array<int>")
    inside = place_among(sorted_literal(points, "string"), len(points), key, first=F.get(bounds, lead), end=F.get(bounds, lead + 1), widest=widest)
    return F.when(key != "", inside).otherwise(F.lit(0).cast("bigint"))


def trie_partition(key: Column, splits: list[str]) -> Column:
    """The range number as a two-level byte trie finds it that looks at the first byte on both levels: for first
    byte c, the number of splits below the key, but at least that of splits below (c, c) and at most that
    below (c, c + 1). The empty key is in range 0. This differs from splits_below in balance only."""
    octets = F.encode(key, "UTF-8")
    first = F.substring(octets, 1, 1)
    after = F.unhex(F.lpad(F.hex(F.conv(F.hex(first), 16, 10).cast("bigint") + 1), 2, "0"))
    points = F.array(*[F.encode(F.lit(s), "UTF-8") for s in splits]).cast("array<binary>")
    below = lambda bound: F.size(F.filter(points, lambda s: s < bound)).cast("bigint")
    inside = F.greatest(F.least(below(octets), below(F.concat(first, after))), below(F.concat(first, first)))
    return F.when(key == "", F.lit(0).cast("bigint")).otherwise(inside)


def wrapped(part: Column, n: int) -> Column:
    _at_least_one(n)
    return F.pmod(part, F.lit(n))


def _at_least_one(n: int) -> None:
    if n < 1:
        raise ValueError("the number of partitions must be at least 1")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
