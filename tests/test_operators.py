import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import functions as fn
from quern import operators as O
from quern import plans, sources
from quern.storage import new_path


def words(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in df.select(F.explode(fn.words(F.col("text")))).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("don't x1y _z", ["don", "t", "x", "y", "z"]),
        ("The the THE", ["The", "the", "THE"]),
        ("12 -- 3.", []),
        ("", []),
        ("éte éte", ["éte", "e", "te"]),
        ("漢字 ªº \U00020000", ["漢字", "ªº", "\U00020000"]),
    ],
)
def test_words_are_letter_runs(spark, text, want):
    assert words(spark, text) == want


def test_null_text_has_no_words(spark):
    assert words(spark, None) == []


@pytest.mark.parametrize(
    ("line", "key"),
    [("  a  b", ""), ("abc   1", "abc"), ("no separator", "no separator"), ("k  1  2", "k"), ("a\r", "a\r")],
)
def test_sort_key(spark, line, key):
    assert spark.createDataFrame([(line,)], "line string").select(fn.sort_key(F.col("line"))).first()[0] == key


def test_lines_split_on_line_feeds_only(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a\n\n\nb\r\nc")
    assert sorted(r[0] for r in sources.lines(spark, [str(tmp_path / "f")]).collect()) == ["a", "b\r", "c"]


def fnv(key):
    h = 2166136261
    for b in key.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h & 0x7FFFFFFF


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12).filter(lambda s: all(not 0xD800 <= ord(c) < 0xE000 for c in s)), min_size=1, max_size=40))
def test_hash_is_fnv1a(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fn.fnv1a(F.col("k")).alias("h"))
    assert all(r.h == fnv(r.k) for r in df.collect())


def test_hash_of_the_empty_key(spark):
    assert spark.createDataFrame([("",)], "k string").select(fn.fnv1a(F.col("k"))).first()[0] == 18652613


def test_range_numbers(spark):
    df = spark.createDataFrame([(k,) for k in ["", "a", "b", "bb", "d", "e", "z"]], "k string")
    got = {r.k: r.p for r in df.select("k", fn.splits_below(F.col("k"), ["b", "d", "e"]).alias("p")).collect()}
    assert got == {"": 0, "a": 0, "b": 0, "bb": 1, "d": 1, "e": 2, "z": 3}


def test_trie_ranges_are_monotone_and_within_brackets(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("abcz") for _ in range(rng.randint(0, 4))) for _ in range(200)})
    splits = sorted(rng.sample(keys, 9))
    got = [r.p for r in spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).select(fn.trie_partition(F.col("k"), splits).alias("p")).collect()]
    assert got == sorted(got)
    for k, p in zip(keys, got, strict=True):
        if k:
            c = k[0]
            low, high = sum(s < c + c for s in splits), sum(s < c + chr(ord(c) + 1) for s in splits)
            assert p == max(low, min(high, sum(s < k for s in splits)))


@pytest.mark.parametrize("n", [0, -1])
def test_partitions_must_be_positive(spark, n):
    with pytest.raises(ValueError):
        fn.hash_partition(F.lit("a"), n)
    with pytest.raises(ValueError):
        plans.JobSpec("wc", ("x",), n)
    with pytest.raises(ValueError):
        O.systematic_sample(spark.createDataFrame([("a",)], "line string"), n)


def test_sample_smaller_than_partitions(spark):
    assert O.split_points(spark.createDataFrame([("b",), ("a",)], "line string"), 5) == ["a", "b"]
    assert O.split_points(spark.createDataFrame([], "line string"), 5) == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab ", max_size=5), max_size=60), st.integers(1, 9))
def test_sample_is_every_step_th_row(spark, rows, n):
    step = max(1, len(rows) // n)
    assert O.split_points(spark.createDataFrame([(r,) for r in rows], "line string"), n) == sorted(rows)[::step]


def test_sum_of_anything_else_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        O.sum_values(spark.createDataFrame([("a", "1"), ("a", "x")], "key string, value string")).collect()


def test_malformed_json_is_an_error(spark, tmp_path):
    (tmp_path / "f").write_text('{"Key": "a", "Value": "1"}\n{"Key": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        sources.kv_json(spark, str(tmp_path / "f")).collect()


def test_json_round_trip_of_odd_strings(spark):
    rows = [("a\\b", 'q"'), ("<&>", "é\n"), ("", "")]
    path = new_path(spark, "odd")
    sources.write_kv_json(spark.createDataFrame(rows, sources.KV), path)
    assert sorted(map(tuple, sources.kv_json(spark, path).collect())) == sorted(rows)


def test_later_part_wins(spark):
    a = spark.createDataFrame([("k", "1"), ("x", "1")], sources.KV)
    b = spark.createDataFrame([("k", "2")], sources.KV)
    assert sorted(map(tuple, O.merge_parts(a, b).collect())) == [("k", "2"), ("x", "1")]


def test_index_counts_rows_not_words(spark):
    docs = spark.createDataFrame([("p", "w w v"), ("p", "w"), ("q", "w")], "doc string, text string")
    assert {r.word: (r.n, r.docs) for r in O.inverted_index(docs, "doc", "text").collect()} == {"w": (3, "p,p,q"), "v": (1, "p")}


def records(n, seed=1):
    rng = random.Random(seed)
    chars = "".join(map(chr, range(32, 127)))
    rows = ["".join(rng.choice(chars) for _ in range(10)) + f"  {i:032X}  {rng.getrandbits(208):052X}" for i in range(n)]
    return [*rows, "  starts with two", "abc   1", "one field", "one field", "abc  2"]


@pytest.mark.parametrize("n", [1, 5, 16])
@pytest.mark.parametrize("files", [1, 3])
def test_total_sort_whatever_the_partitions(spark, tmp_path, n, files):
    rows = records(300)
    for i in range(files):
        (tmp_path / f"part{i}").write_text("\n".join(rows[i::files]) + "\n")
    (tmp_path / "sample").write_text("\n".join(rows[::7]))
    want = sorted((r.split("  ")[0], r) for r in rows)
    inputs = tuple(str(tmp_path / f"part{i}") for i in range(files))
    for sample in (None, str(tmp_path / "sample")):
        got = [tuple(r) for r in plans.run_job(spark, plans.JobSpec("srt", inputs, n, sample)).collect()]
        assert sorted(got) == want
    assert [tuple(r) for r in plans.run_job(spark, plans.JobSpec("srt", inputs)).collect()] == want


def test_ranks_are_gapless_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = O.ranked(df.repartition(6), ["v"]).collect()
    assert all(r.rn == r.v + 1 for r in got) and len(got) == 5000


def test_more_partitions_than_keys_adds_nothing(spark, tmp_path):
    (tmp_path / "f").write_text("a b a")
    got = plans.run_job(spark, plans.JobSpec("wc", (str(tmp_path / "f"),), 16)).collect()
    assert sorted(map(tuple, got)) == [("a", "2"), ("b", "1")]


def test_final_text_in_order(spark, tmp_path):
    kv = spark.createDataFrame([("b", "1"), ("a", "2")], sources.KV)
    sources.write_final(kv, str(tmp_path / "out"), single=True)
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*")] == ["a: 2\nb: 1\n"]
    with pytest.raises(ValueError):
        sources.final_line(form="other")


def test_unknown_job(spark):
    with pytest.raises(KeyError):
        plans.run_job(spark, plans.JobSpec("nothing", ("x",)))


def test_python_job_equals_the_built_in_one(spark, tmp_path):
    (tmp_path / "f").write_text("b a b")
    (tmp_path / "g").write_text("a c\n")
    job = plans.python_job(lambda d, t: ((w, "1") for w in t.split()), lambda k, v: str(sum(map(int, v))))
    plans.JOBS.pop("mine", None)
    plans.register("mine", job)
    inputs = (str(tmp_path / "f"), str(tmp_path / "g"))
    got, want = ([tuple(r) for r in plans.run_job(spark, plans.JobSpec(j, inputs)).collect()] for j in ("mine", "wc"))
    assert got == want == [("a", "2"), ("b", "2"), ("c", "1")]
    with pytest.raises(ValueError):
        plans.register("mine", job)


def test_command_line(spark, tmp_path):
    from quern.__main__ import main

    (tmp_path / "f").write_text("x y x")
    main(["run", "ii", str(tmp_path / "f"), "--output", str(tmp_path / "o"), "--single"])
    assert [p.read_text() for p in (tmp_path / "o").glob("part-*")] == [f"x: 1 {tmp_path}/f\ny: 1 {tmp_path}/f\n"]


def parts_of(folder):
    return sorted(folder.glob("part-*"))


@pytest.mark.parametrize("n", [3, 17])
def test_command_line_writes_the_partitions_asked_for(spark, tmp_path, n):
    from quern.__main__ import main

    rows = records(300)
    (tmp_path / "data").write_text("\n".join(rows))
    main(["run", "srt", str(tmp_path / "data"), "--output", str(tmp_path / "o"), "--partitions", str(n)])
    assert len(parts_of(tmp_path / "o")) == n
    assert [x for p in parts_of(tmp_path / "o") for x in p.read_text().splitlines()] == sorted(rows, key=lambda r: (r.split("  ")[0], r))


def test_command_line_writes_a_file_for_each_range_of_the_sample(spark, tmp_path):
    from quern.__main__ import main

    rows = records(300)
    (tmp_path / "data").write_text("\n".join(rows))
    (tmp_path / "sample").write_text("\n".join(rows[:40]))
    main(["run", "srt", str(tmp_path / "data"), "--output", str(tmp_path / "o"), "--partitions", "20", "--sample", str(tmp_path / "sample")])
    splits = sorted(rows[:40])[::2]
    by_range = {}
    for r in sorted(rows, key=lambda r: (r.split("  ")[0], r)):
        by_range.setdefault(sum(s < r.split("  ")[0] for s in splits), []).append(r)
    got = {int(p.name.split("-")[1]): p.read_text().splitlines() for p in parts_of(tmp_path / "o")}
    assert {i: x for i, x in got.items() if x} == by_range and len(by_range) > 15


def test_mapped_pairs_are_combined_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(plans, "HELD", 5)
    docs = spark.createDataFrame([(1, "a b a a b c a"), (2, None), (None, "a")], "id long, text string").coalesce(1)
    words = lambda d, t: ((w, "1") for w in t.split())
    summed = lambda k, v: str(sum(map(int, v)))
    pairs = plans.map_documents(docs, "id", "text", words, combine=summed)
    assert sorted(map(tuple, pairs.collect())) == [("a", "2"), ("a", "3"), ("b", "2"), ("c", "1")]
    assert plans.map_documents(docs, "id", "text", words).count() == 8
    assert dict(map(tuple, plans.reduce_by_key(pairs, summed).collect())) == {"a": "5", "b": "2", "c": "1"}


def test_a_reduce_function_need_not_read_its_values(spark):
    kv = spark.createDataFrame([(k, str(i)) for k in "ab" for i in range(3)], sources.KV)
    assert dict(map(tuple, plans.reduce_by_key(kv, lambda k, v: next(v)).collect())) == {"a": "0", "b": "0"}


def test_union_of_parts_keeps_rows_of_any_id(tmp_path, spark):
    from quern import queries

    rows = [(1, "a"), (-1, "b"), (None, "c"), (2, "d"), (-6, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, queries.implicit_union(spark, str(tmp_path)).collect()))
    assert got == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_json_parts_are_folders(spark, tmp_path):
    rows = [("a", "1", 0), ("b", "2", 3), ("c", "3", 3)]
    sources.write_kv_json(spark.createDataFrame(rows, "key string, value string, part long"), str(tmp_path / "o"), "part")
    assert sorted(p.name for p in (tmp_path / "o").glob("part=*")) == ["part=0", "part=3"]
    assert sorted(map(tuple, sources.kv_json(spark, str(tmp_path / "o" / "part=3")).collect())) == [("b", "2"), ("c", "3")]


def trie_number(key, splits):
    """The number by walking the bytes: brackets of a first-byte level, then of a second that looks at it again."""
    if not key:
        return 0
    key, splits = key.encode(), [s.encode() for s in splits]
    below = lambda x: sum(s < x for s in splits)
    c = key[0]
    after = bytes([c, c + 1]) if c < 255 else bytes([c]) + b"\xff" * 9
    return max(min(below(key), below(after)), below(bytes([c, c])))


def test_trie_ranges_of_bytes_beyond_ascii(spark):
    splits = sorted(["é", "éa", "éé", "漢", "漢字", "a", "aé", "\U0001f600", "\U0001f600x", "ÿ", "z"], key=str.encode)
    keys = ["", "é", "éz", "漢", "漢a", "字", "\U0001f600", "\U0001f600y", "\U0010ffff", "ÿÿ", "a", "aa", "ab", "b", "zz"]
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", fn.trie_partition(F.col("key"), splits).alias("p"))
    assert {r.key: r.p for r in df.collect()} == {k: trie_number(k, splits) for k in keys}


def test_a_task_that_fails_once_is_run_again(spark):
    def once(batches):
        from pyspark import TaskContext

        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")
        yield from batches

    df = spark.createDataFrame([("a b",), ("b",), ("c",)], "text string").repartition(3).mapInPandas(once, "text string")
    assert {r.word: r.n for r in O.count_words(df, "text").collect()} == {"a": 1, "b": 2, "c": 1}


def test_stream_follows_a_folder(spark, tmp_path):
    from quern.streaming import stream_word_counts

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "f").write_text("a b\na")
    (folder / "g").write_text("b c")
    q = stream_word_counts(spark, str(folder), 1).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.word: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 2, "c": 1}


def test_counts_are_combined_before_the_shuffle_and_columns_pruned(spark):
    from conftest import DATA

    plan = O.count_words(spark.read.parquet(f"{DATA}/documents.parquet"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1
    assert "ReadSchema: struct<text:string>" in plan
