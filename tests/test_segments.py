"""Lists in segments, samples, differences, order."""

import random
from bisect import bisect_left
from collections import Counter
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from quern import functions as fn
from quern import operators as O
from quern import sources
from quern.operators import difference as D
from quern.operators import sampling, segments


def pairs(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


# Segments


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_segments_cut_each_keys_sorted_values(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", "é"]), str(rng.randrange(60))) for _ in range(900)] + [(None, "x")] * 9
    got = segments.value_segments(pairs(spark, rows).repartition(5), most).collect()
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert {(r.key, r.segment) for r in got} == {(k, s) for k, v in want.items() for s in range(-(-len(v) // most))}
    for r in got:
        own = sorted(want[r.key])[r.segment * most : (r.segment + 1) * most]
        assert (list(r["values"]), r.n, r.first, r.last) == (own, len(own), own[0], own[-1])
    assert len([r for r in got if r.key == "hot"]) > (most < 1000)


def test_a_segment_holds_something(spark):
    with pytest.raises(ValueError):
        segments.value_segments(pairs(spark, []), 0)
    assert segments.value_segments(pairs(spark, [])).count() == 0


def test_an_index_is_read_back_from_its_segments(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:03}", "every word" + " even" * (i % 2 == 0) + " tenth" * (i % 10 == 0)) for i in range(200)], "doc string, text string")
    segments.write_index(segments.index_segments(O.distinct_tokens(docs, "doc", "text"), 30), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r.n for r in index.filter("word = 'every'").collect()) == [20] + [30] * 6
    assert [tuple(r) for r in segments.postings(index, "tenth").collect()] == [("tenth", f"d{i:03}") for i in range(0, 200, 10)]
    assert sorted(r.doc for r in segments.documents_with_all(index, "every", "tenth", "even").collect()) == [f"d{i:03}" for i in range(0, 200, 10)]
    assert segments.documents_with_all(index, "every", "absent").count() == 0
    plan = segments.postings(index, "tenth")._jdf.queryExecution().toString()
    assert "EqualTo(word,tenth)" in plan.split("PushedFilters: ")[-1]


# Index over split points


@pytest.mark.parametrize("n", [0, 1, 2, 10, 10_000])
def test_split_points_are_searched_by_halves(spark, n):
    rng = random.Random(n)
    letters = ["a", "b", " ", "\0", "\x7f", "é", "漢", "\U0001f600", "z", '"', "\\"]
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    splits, keys = [word(6) for _ in range(n)], [word(6) for _ in range(500)] + [""]
    points = sorted(s.encode() for s in splits)
    got = spark.createDataFrame([(k,) for k in [*keys, None, *splits[:50]]], "k string").select("k", fn.splits_below(F.col("k"), splits).alias("p")).collect()
    assert all(r.p == (bisect_left(points, r.k.encode()) if r.k is not None else 0) for r in got)


def test_split_points_are_one_literal_of_the_plan(spark):
    df = spark.range(5).select(fn.splits_below(F.col("id").cast("string"), [f"s{i:05}" for i in range(10_000)]).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "s09999" not in plan.split("\n")[0][:2000]


# Samples


@pytest.mark.parametrize("rows", [500, 20_000, 200_000])
def test_sampled_split_points_are_near_their_ranks(spark, rows):
    size, n = 2000, 8
    df = spark.range(rows).select(F.lpad(((F.col("id") * 7919) % rows).cast("string"), 7, "0").alias("line")).repartition(6)
    points = sampling.approximate_split_points(df, n, size=size)
    assert len(points) == n - 1
    bound = sqrt(log(2 / 1e-6) / (2 * size))  # as the docstring says
    assert max(abs(int(p) / rows - i / n) for i, p in enumerate(points, 1)) <= bound


def test_sampling_scans_once_and_sorts_nothing(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("line")).write.text(str(tmp_path / "t"))
    plan = sampling.least_hashes(sources.lines(spark, [str(tmp_path / "t")]), 10)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("FileScan") == 1 and "TakeOrderedAndProject" in final and " Sort " not in final


def test_samples_of_repeated_null_few_and_no_rows(spark):
    df = lambda rows: spark.createDataFrame([(x,) for x in rows], "line string")
    assert sampling.approximate_split_points(df([]), 4) == []
    assert sampling.approximate_split_points(df(["b", "a", None]), 4) == ["a", "b"]
    assert sampling.approximate_split_points(df(["same"] * 50), 4) == ["same"] * 3
    assert sampling.least_hashes(df(["x"] * 50 + ["y"]), 20).count() == 20
    with pytest.raises(ValueError):
        sampling.approximate_split_points(df(["a"]), 0)


def test_the_sample_of_a_whole_is_merged_from_those_of_its_parts(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("line"))
    hashed = F.xxhash64("line")
    whole = {r.line for r in sampling.least_hashes(df.repartition(7), 50, hashed).collect()}
    parts = [sampling.least_hashes(df.filter(F.col("line") % 2 == i), 50, hashed) for i in range(2)]
    assert whole == {r.line for r in sampling.least_hashes(parts[0].unionByName(parts[1]), 50, hashed).collect()}
    assert whole == {r.line for r in df.orderBy(hashed).limit(50).collect()}


# Differences


def test_difference_counts_what_is_missing_and_what_is_too_much(spark):
    got = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "x string, y int")
    want = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "c")], "y int, x string")
    assert {(r.x, r.y): r.surplus for r in D.difference(got, want).collect()} == {("a", 1): 1, ("b", 2): -1, ("c", 4): -1}
    assert D.difference(got, got).count() == 0
    with pytest.raises(ValueError, match="differ"):
        D.difference(got, want.drop("y"))
    with pytest.raises(ValueError, match="exists"):
        D.difference(got, got, name="X")


def test_jobs_are_the_same_by_difference(spark, tmp_path):
    from quern import plans

    (tmp_path / "f").write_text("b a b\n\nc")
    by_job = plans.run_job(spark, plans.JobSpec("wc", (str(tmp_path / "f"),)))
    by_counts = O.count_words(sources.documents(spark, [str(tmp_path / "f")]), "contents").select(F.col("word").alias("key"), F.col("n").cast("string").alias("value"))
    assert D.difference(by_job, by_counts).count() == 0


def test_breaks_of_order_in_and_between_files(spark, tmp_path):
    parts = {"part-0": ["a", "b", "b"], "part-1": ["b", "a", "é", "z"], "part-2": [], "part-3": ["zz"], "part-4": ["zz", "zzz", "x", "y"]}
    for name, lines in parts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    want, last = {}, b""
    for name, lines in parts.items():
        for x in lines:
            n, breaks = want.get(name, (0, 0))
            want[name] = (n + 1, breaks + (x.encode() < last))
            last = x.encode()
    got = {r.file.rsplit("/", 1)[1]: (r.n, r.breaks) for r in D.order_breaks(spark, str(tmp_path)).collect()}
    assert got == want and sum(b for _, b in want.values()) == 3


def test_breaks_of_a_file_that_many_tasks_read(spark, tmp_path):
    lines = [f"{i:06}" for i in range(20_000)]
    lines[700], lines[15_000] = lines[15_000], lines[700]
    (tmp_path / "part-0").write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert [(r.n, r.breaks) for r in D.order_breaks(spark, str(tmp_path)).collect()] == [(20_000, sum(a > b for a, b in zip(lines, lines[1:], strict=False)))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_numbers_follow_the_rows_as_they_lie(spark):
    df = spark.range(100, numPartitions=7).select("id")
    assert all(r.rn == r.id + 1 for r in O.numbered(df).collect())
    assert Counter(r.rn for r in O.numbered(df, start=0).collect()) == Counter(range(100))


@pytest.mark.parametrize("most", [1, 7, 100, 5000])
def test_runs_are_written_and_dealt_in_place_of_pairs(spark, monkeypatch, most):
    written = []
    monkeypatch.setattr(segments, "stored", lambda df, name, f=segments.stored: written.append(f(df, name)) or written[-1])
    rows = [("a", f"{i % 700:04}") for i in range(2500)] + [("b", f"{i:05}") for i in range(1500)] + [(None, "x")] * 9 + [("c", ""), ("é", "z")]
    kv = spark.createDataFrame(rows, "key string, value string").repartition(6)
    told = {(r.key, r.segment): (r.first, r.last, r.n, r["values"]) for r in segments.value_segments(kv, most).collect()}
    wanted = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for key, v in rows if key == k)
        for i in range(0, len(values), most):
            v = values[i : i + most]
            wanted[k, i // most] = (v[0], v[-1], len(v), v)
    assert told == wanted
    assert written[0].count() < len(rows) / 10


def test_runs_cross_batches_and_nulls_count(spark):
    batch_size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_size)
    spark.conf.set(batch_size, "3")
    try:
        kv = spark.createDataFrame([("k", None)] * 2 + [("k", str(i)) for i in range(8)], "key string, value string")
        told = sorted((r.segment, r.first, r.last, r.n, r["values"]) for r in segments.value_segments(kv, 4).collect())
    finally:
        spark.conf.set(batch_size, before)
    assert told == [(0, "0", "1", 4, ["0", "1"]), (1, "2", "5", 4, ["2", "3", "4", "5"]), (2, "6", "7", 2, ["6", "7"])]
