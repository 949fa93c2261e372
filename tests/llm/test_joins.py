import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import docs, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import _bytes as B
from quern.llm import embedding_dedup, jaccard_join, suffix_dedup
from quern.llm._shared import components, join_groups


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1300)]
    edges = chain + star + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    ids = {v for e in edges if e[0] != e[1] for v in e}
    got = {r.id: r.component for r in components(spark.createDataFrame([*edges, (None, 4), (5, 5)], "a long, b long")).collect()}
    assert got == brute_components(ids, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_groups_join_once(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = join_groups(rows, groups, ["k"], "n", 5000)
    assert out.count() == 5000 and out.filter("k = -1 and n <> 3000").count() == 0


# Jaccard


def shingles(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_keys_leave_a_task_in_small_batches(monkeypatch):
    """What a task holds beside its keys does not grow with their number, and connections are those of all of them."""
    rng = random.Random(4)
    texts = prose(rng, 3000, 4000)
    texts += [t + " more" for t in texts[:300]]
    batch = pa.record_batch({"id": range(len(texts)), "text": texts})
    common = SimpleNamespace(value=np.zeros(0, np.uint64))

    def run(parts, out):
        monkeypatch.setattr(jaccard_join, "KEY_PARTS", parts)
        monkeypatch.setattr(jaccard_join, "ROWS_OUT", out)
        rows, most = [], 0
        tracemalloc.start()
        for b in jaccard_join._keys(2, 4, 5, common)(iter([batch])):
            most = max(most, b.num_rows)
            rows += zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
        tracemalloc.stop()
        return sorted(rows, key=str), most

    got, most = run(16, 1000)
    assert most <= 1000 < len(got) and got == run(1, 1 << 20)[0]
    # As many as 2^21 keys are merged in much less room than several copies of all take.
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1 << 19).astype(np.uint64) << np.uint64(1)
    monkeypatch.setattr(jaccard_join, "KEY_PARTS", 16)
    monkeypatch.setattr(jaccard_join, "ROWS_OUT", 1 << 17)
    monkeypatch.setattr(jaccard_join, "block_keys", lambda *_: (np.zeros(len(keys), np.int64), keys))
    tracemalloc.start()
    for b in jaccard_join._keys(2, 4, 5, common)(iter([batch.slice(0, 1)])):
        assert b.num_rows <= 1 << 17
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * 16 * len(keys)


def brute_jaccard(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = brute_components(ids, links)
    count = dict.fromkeys(ids, 0)
    for e in links:
        for v in e:
            count[v] += 1
    return {(i, len(sets[i]), count[i], comp[i]) for i in ids}


def near_copies(seed, n=60):
    rng = random.Random(seed)
    out = prose(rng, 40)
    for base in prose(rng, 3, 3000):
        base = (base + " ") * 2
        for _ in range(n):
            w = base.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(["zz", "Yy", "q"])
            out.append(" ".join(w))
    passage = " ".join(prose(rng, 3))
    out += [f"{passage} {t}" for t in prose(rng, 40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_is_exact(spark, width, num, den):
    texts = near_copies(width)
    got = jaccard_join.jaccard_classes(docs(spark, texts).repartition(3), width, num, den, block_rows=25).collect()
    assert {tuple(r) for r in got} == brute_jaccard(list(enumerate(texts)), width, num, den) and len(got) == len(texts)


def test_a_long_text_is_a_block_of_its_own(spark):
    texts = near_copies(3, 20)
    got = jaccard_join.jaccard_classes(docs(spark, texts), 3, 9, 10, block_rows=50, block_entries=20_000).collect()
    assert {tuple(r) for r in got} == brute_jaccard(list(enumerate(texts)), 3, 9, 10)


@pytest.mark.parametrize("held", [1, 50, 1 << 21])
def test_keys_are_met_in_the_task(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard_join, "HELD_KEYS", held)
    texts = near_copies(7, 25)
    got = jaccard_join.jaccard_classes(docs(spark, texts).repartition(3), 5, 4, 5, block_rows=25).collect()
    assert {tuple(r) for r in got} == brute_jaccard(list(enumerate(texts)), 5, 4, 5)


def test_a_family_of_many_distinct_sets(spark):
    """20,000 sets that share all words but one: each is linked with all others."""
    n, common = 20_000, " ".join(f"w{i}" for i in range(40))
    texts = spark.range(n, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit(common + " x"), F.col("id").cast("string")).alias("text"))
    got = jaccard_join.jaccard_classes(texts, 1, 9, 10).groupBy("n_shingles", "n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(41, n - 1, 0, n)]


def test_only_packs_with_a_common_key_are_multiplied(spark, monkeypatch):
    """A family that hangs together by keys alone, as many chance ones do where no n-grams are left aside."""
    from conftest import DATA

    monkeypatch.setattr(jaccard_join, "MOST_COMMON", 0)
    rows = spark.read.parquet(str(DATA).replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text")
    seen = []
    real = jaccard_join.meeting_packs

    def counted(packs):
        pairs = real(packs)
        of = packs.groupBy("block").agg(F.count("*").alias("n")).collect()
        seen.append((pairs.count(), sum(r.n * (r.n + 1) // 2 for r in of), max((r.n for r in of), default=0)))
        return pairs

    monkeypatch.setattr(jaccard_join, "meeting_packs", counted)
    aside = jaccard_join.jaccard_classes(rows, 5, 4, 5, block_rows=25).collect()
    (products, whole, packs) = seen[0]
    assert packs > 20 and products < whole / 2, seen
    monkeypatch.setattr(jaccard_join, "MOST_COMMON", 200_000)
    assert sorted(map(tuple, aside)) == sorted(map(tuple, jaccard_join.jaccard_classes(rows, 5, 4, 5).collect()))


def test_overlaps_are_whole_numbers():
    """Pairs exactly at the bound, of sets so large that float32 would round."""
    shared = 900_011
    both, size = np.array([[0, 19 * shared], [0, 0]]), np.array([20 * shared - 0, 19 * shared])
    x, y = jaccard_join.linked(both[:1, 1:], size, 1, 19, 20)
    assert (x.tolist(), y.tolist()) == ([0], [1])
    assert not len(jaccard_join.linked(both[:1, 1:] - 1, size, 1, 19, 20)[0])
    column = np.concatenate([np.arange(6000), np.arange(2000, 9000)] * 5)
    got = jaccard_join.overlaps(column, np.array([6000, 7000] * 5), 10)
    assert got[0, 1] == 4000 and got[0, 2] == 6000 and got[1, 3] == 7000 and got.dtype.kind == "i"


def test_ids_that_are_no_numbers_are_an_error(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        jaccard_join.jaccard_classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in odd_rows()], "doc_id long, text string, n int, component_id int")
    got = jaccard_join.jaccard_classes(df).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[7].component_id == 6 and by[6].n_links == 1
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (1, 2, 3))
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join.jaccard_classes(df.filter("false")).count() == 0
    left = jaccard_join.drop_near_copies(df)
    assert left.columns == df.columns and left.count() == len(odd_rows()) - 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([(9, 10), (4, 5), (1, 2)]))
def test_linked_sets_share_a_key(seed, n, share):
    num, den = share
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = a.copy()
    while True:  # change b as far as the bound allows, growing or shrinking it
        c = np.delete(b, rng.integers(len(b))) if len(b) > 1 and rng.random() < 0.5 else np.unique(np.append(b, rng.integers(0, 2**63)).astype(np.uint64))
        both = len(np.intersect1d(a, c))
        if den * both < num * (len(a) + len(c) - both):
            break
        b = c
    if np.array_equal(a, b):
        return
    for share in (0, 0.3, 0.8, 1):
        common = np.sort(a[rng.random(len(a)) < share])
        who, key = jaccard_join.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), num, den, common)
        assert set(key[who == 0]) & set(key[who == 1])


def test_word_spans_and_hashes_by_row():
    import pyarrow as pa

    texts = ["a b", None, "", "b  a\tb", "\x0bé\r", "ab"]
    for i, j, data, at in B.text_batches(pa.array(texts)):
        start, stop, row = B.word_spans(data, at)
        assert [data[s:e].tobytes().decode() for s, e in zip(start, stop, strict=True)] == ["a", "b", "b", "a", "b", "é", "ab"]
        assert row.tolist() == [0, 0, 3, 3, 3, 4, 5] and (i, j) == (0, 6)
        h = B.word_hashes(data, start, stop)
        assert h[0] == h[3] and h[1] == h[2] == h[4] and len(set(h.tolist())) == 4
        assert B.word_hashes(data, start, stop, 1).tolist() == h.tolist()


# Vectors


def brute_vectors(rows, cosine=0.9):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = [i for i, _ in rows]
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= cosine]
    comp = brute_components(ids, links)
    return {(i, sum(i in e for e in links), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * (0.1 + 0.4 * (i % 5) / 4)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [float("nan")] * 12), (2004, [None] + [1.0] * 11), (2005, [float("inf")] * 12), (2006, [1e-40] * 12), (2007, [3e38] * 12), (2008, [1.0, 2.0]), (2009, [1.0, 2.1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, v int, id string").repartition(4)
    got = embedding_dedup.near_vectors(df, 0.9, block_bytes=12 * 4 * 40, fan=3)
    assert {tuple(r) for r in got.collect()} == brute_vectors(rows)
    assert embedding_dedup.near_vectors(df.filter("false")).count() == 0
    assert embedding_dedup.near_vectors(df.filter("vec_id = 2000")).collect()[0].kept
    with pytest.raises(ValueError):
        embedding_dedup.near_vectors(df, 0.0)


def test_blocks_meet_as_their_boxes_say(spark):
    rng = np.random.default_rng(5)
    lo = np.sort(rng.random((90, 3)), axis=0) * 4
    hi = lo + rng.random((90, 3)) * 0.3
    boxes = spark.createDataFrame([(i, lo[i].tolist(), hi[i].tolist()) for i in range(90)], "id long, lo array<double>, hi array<double>").repartition(5)
    got = sorted(map(tuple, embedding_dedup.meeting_blocks(boxes, 0.2, 4).collect()))
    gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
    want = [(a, b) for a, b in np.argwhere((gap**2).sum(2) <= 0.2).tolist() if a <= b]
    assert got == want and len(want) < 90 * 91 / 6
    assert [tuple(r) for r in embedding_dedup.meeting_blocks(boxes.filter("id = 0"), 0.2).collect()] == [(0, 0)]


def test_blocks_are_sent_less_often_than_the_square_of_their_number(spark):
    sent = {}
    for n in (16, 32, 64):
        boxes = spark.createDataFrame([(i, [0.0], [1.0]) for i in range(n)], "id long, lo array<double>, hi array<double>")
        pairs = embedding_dedup.meeting_blocks(boxes, 0.1)  # evenly spread vectors: all blocks meet
        placed, sides = embedding_dedup.tiles(pairs, embedding_dedup.tile_width(n, 1))
        assert placed.count() == n * (n + 1) // 2
        of = {(r.ta, r.tb, r.id) for r in sides.collect()}
        assert all({(r.ta, r.tb, r.a), (r.ta, r.tb, r.b)} <= of for r in placed.collect())
        sent[n] = len(of)
    assert sent[32] < 4 * sent[16] and sent[64] < 4 * sent[32] and sent[64] < 10 * sent[16]  # the square: 16 times
    assert embedding_dedup.tile_width(10_000, 1 << 20, 8 << 20) == 8  # what a task holds is bounded


def test_a_tasks_rows_are_cut_into_equal_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.standard_normal((3000, 8)))]
    counts = []
    real = embedding_dedup.meeting_blocks
    monkeypatch.setattr(embedding_dedup, "meeting_blocks", lambda boxes, *a: counts.append(boxes.count()) or real(boxes, *a))
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, block_bytes=100 * 8 * 8).count()
    assert 25 <= counts[0] <= 36


def test_null_and_repeated_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()), key=str)
    # Rows of one id are one vertex: what they are linked with is one component.
    assert {(i, c) for i, _, c, _ in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    assert (None, 0, None, True) in got and (4, 0, 4, True) in got


def test_clustered_vectors_meet_few_blocks(spark, monkeypatch):
    """Vectors whose leading dimensions keep them apart: pairs of blocks grow as the blocks do, not as their square."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    rng, met = np.random.default_rng(6), []
    real = embedding_dedup.meeting_blocks
    monkeypatch.setattr(embedding_dedup, "meeting_blocks", lambda *a: met.append((a[0].count(), (out := real(*a)).count())) or out)
    for n in (12, 48):
        turn = rng.random(n) * 2 * np.pi
        centres = np.stack([np.cos(turn), np.sin(turn), 2 * rng.random(n) - 1, 2 * rng.random(n) - 1], 1)
        rows = [(i, (centres[i % n] + rng.normal(size=4) * 0.01).tolist()) for i in range(40 * n)]
        embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99, block_bytes=4 * 8 * 20, fan=4).count()
    (few, some), (many, more) = met
    assert many > 3 * few and more < 0.25 * many * many / 2 and some <= few * (few + 1) / 2


def test_intervals_far_apart_are_left_out():
    rng = np.random.default_rng(3)
    x = embedding_dedup.unit(rng.normal(size=(900, 5)))
    axes = np.linalg.eigh(np.cov(x.T))[1]
    x = x[np.lexsort(np.floor(x @ axes / 0.45).T[::-1])]
    i, j = embedding_dedup.join_intervals(x, x, axes, 0.9, True, 32)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if a < b}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


# Repeated strings


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(w)
        spans, s = [], None
        for k, g in enumerate([*gone, 0]):
            if g and s is None:
                s = k
            if not g and s is not None:
                spans.append((s, k))
                s = None
        out.setdefault(i, []).append((len(b), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repeats_are_exact(spark, seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abé \n漢") for _ in range(rng.randint(20, 260))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    rows += [(200, "a" * 700), (201, "a" * 99), (202, "a" * 100), (203, "ab" * 300), (204, "\0" * 250), (205, None), (206, ""), (None, rows[5][1] + "tail"), (207, "x" + "b" * 99), (208, "y" + "b" * 99)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, spans int, id int").repartition(3)
    got = suffix_dedup.remove_repeats(df).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) in want[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(df.filter("false")).count() == 0


def test_no_task_merges_all_rows_of_a_hot_anchor(spark, monkeypatch):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, near = letters(300), [letters(80) for _ in range(4)]
    rows = [(i, letters(60) + rng.choice(near) + passage + rng.choice(near) + letters(60)) for i in range(300)]
    rows += [(None, passage), (900, passage[:150] + passage[90:])]
    merge = suffix_dedup._merge

    def bounded(group):
        keys = group.filter(pc.is_valid(group.column("text"))).column("key").to_pylist()
        assert max(Counter(keys).values(), default=0) <= 50
        return merge(group)

    monkeypatch.setattr(suffix_dedup, "_merge", bounded)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 50, raising=False)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) in want[r.doc_id], r.doc_id


def test_one_passage_in_very_many_documents(spark, monkeypatch):
    """The strings across its edges have few anchors, each in all documents: no task gets their rows."""
    n, passage = 50_000, "".join(random.Random(3).choices("abcdefgh", k=300))
    merge = suffix_dedup._merge

    def bounded(group):
        keys = group.filter(pc.is_valid(group.column("text"))).column("key").to_pylist()
        assert max(Counter(keys).values(), default=0) <= 5_000 and group.num_rows <= 60_000
        return merge(group)

    monkeypatch.setattr(suffix_dedup, "_merge", bounded)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 5_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", 5_000)
    text = F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(passage), F.sha2(F.concat(F.lit("x"), "id"), 256))
    df = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = suffix_dedup.remove_repeats(df)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda k, s: k + s["end"] - s["start"])
    by = {r.n: r.c for r in got.groupBy(F.size("spans").alias("n")).agg(F.count("*").alias("c")).collect()}
    assert by == {0: 1, 1: n - 1}
    least, most = got.filter("doc_id > 0").agg(F.min(removed), F.max(removed)).first()
    assert 300 <= least and most < 300 + 2 * 12  # what the neighbours happen to share with earlier ones


def test_repeats_of_repeated_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    assert sorted(len(r.kept) for r in suffix_dedup.remove_repeats(df).collect()) == [0, 5, 5, 300]


def test_pieces_of_a_long_text_meet(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    at = np.array([0, 50, 1500, 1500, 3000])

    def starts():
        key, place, lo, hi, row = suffix_dedup.anchors(data, at)
        return sorted((s, p, k, r) for k, p, a, b, r in zip(key.tolist(), place.tolist(), lo.tolist(), hi.tolist(), row.tolist(), strict=True) for s in range(a, b + 1))

    want = starts()
    assert [s for s, *_ in want] == [*range(50, 1401), *range(1500, 2901)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 257)
    assert starts() == want
