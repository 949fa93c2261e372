"""Files in splits, ranges that are too large, plugins, folds, jobs beside one another."""

import time
from collections import Counter
from concurrent.futures import CancelledError

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import operators as O
from quern import plans, queries, sources, storage
from quern.__main__ import main
from quern.plans import handles, plugins
from quern.plans.folds import fold_by_key, fold_job
from quern.plans.ranges import by_split_points

# Files in splits


def result(spark, job, *inputs):
    return dict(map(tuple, plans.run_job(spark, plans.JobSpec(job, tuple(map(str, inputs)))).collect()))


def test_a_large_file_is_many_tasks(spark, tmp_path):
    line = "one two two three\n"
    with open(tmp_path / "large", "w") as f:
        for _ in range(30):
            f.write(line * (10_000_000 // len(line)))
    n = 30 * (10_000_000 // len(line))
    lines = sources.file_lines(spark, [str(tmp_path / "large")])
    assert lines.rdd.getNumPartitions() > 2
    assert result(spark, "wc", tmp_path / "large") == {"one": str(n), "two": str(2 * n), "three": str(n)}
    assert result(spark, "ii", tmp_path / "large") == {w: f"1 {tmp_path}/large" for w in ("one", "two", "three")}


def test_a_file_of_one_very_long_line(spark, tmp_path):
    (tmp_path / "f").write_text("word other " * 1_000_000)
    assert result(spark, "wc", tmp_path / "f") == {"word": "1000000", "other": "1000000"}


def test_files_listed_twice_count_twice(spark, tmp_path):
    (tmp_path / "f").write_text("w w\n\nw v\r\nw")
    (tmp_path / "g").write_text("w")
    f, g = str(tmp_path / "f"), str(tmp_path / "g")
    assert result(spark, "wc", f, g, f) == {"w": "9", "v": "2"}
    assert result(spark, "ii", f, g, f) == {"w": f"3 {f},{f},{g}", "v": f"2 {f},{f}"}
    assert Counter(r.copy for r in sources.file_lines(spark, [f, g, f]).collect()) == {0: 4, 1: 3}


def test_an_index_of_many_files_in_segments(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"f{i}").write_text("every" + " one" * (i == 3))
    monkeypatch.setattr(plans, "_segments", lambda pairs: plans.value_segments(pairs, 2))
    names = [f"{tmp_path}/f{i}" for i in range(5)]
    assert result(spark, "iis", tmp_path) == {"every": f"000000000 5 {','.join(names)}", "one": f"000000000 1 {names[3]}"}
    cut = plans._segments(plans._words_by_file(spark, plans.JobSpec("iis", (str(tmp_path),)))).collect()
    assert sorted((r.key, r.segment, r.n) for r in cut) == [("every", 0, 2), ("every", 1, 2), ("every", 2, 1), ("one", 0, 1)]


# Ranges


def dealt(df):
    """Rows of each partition."""
    rows = df.sortWithinPartitions("key", "value").select(F.spark_partition_id().alias("p"), "key", "value").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.p, []).append((r.key, r["value"]))
    return [parts[p] for p in sorted(parts)]


@pytest.mark.parametrize("most", [100, 300])
def test_a_range_that_the_sample_missed_is_cut_again(spark, most):
    rows = [(f"k{i * 7919 % 3000:05}", str(i)) for i in range(3000)] + [(f"a{i}", "") for i in range(40)] + [("hot", "same")] * 700
    kv = spark.createDataFrame(rows, "key string, value string").repartition(5)
    parts = dealt(by_split_points(kv, ["a3", "b", "c"], most))  # of keys, 90 % and more are above c
    assert [r for p in parts for r in p] == sorted(rows)
    assert max(map(len, parts)) <= most and len(parts) > 3700 // most
    assert parts[0] == sorted(r for r in rows if r[0] <= "a3")  # small ranges stay whole


def test_ranges_of_ordinary_size_are_those_of_the_split_points(spark):
    rows = [(k, "") for k in "abcdefgh" for _ in range(50)]
    kv = spark.createDataFrame(rows, "key string, value string")
    assert [sorted({k for k, _ in p}) for p in dealt(by_split_points(kv, ["b", "d"]))] == [["a", "b"], ["c", "d"], ["e", "f", "g", "h"]]
    assert dealt(by_split_points(kv.filter("false"), ["b", "d"])) == []
    with pytest.raises(ValueError):
        by_split_points(kv, ["b"], 0)

@pytest.mark.parametrize("job", ["ii", "wc", "srt"])
def test_sorted_ranges_stay_small(spark, tmp_path, monkeypatch, job):
    for i in range(40):
        (tmp_path / f"{i}").write_text("".join(f"{a}{b}{c}  \n" for a in "abcdef" for b in "ghijklm" for c in "nopq"))
    spec = plans.JobSpec(job, (str(tmp_path),), partitions=2)
    few = dealt(plans.run_job(spark, spec))
    assert len(few) == 2
    monkeypatch.setattr("quern.plans.ranges.RANGE_BYTES", 20_000)
    parts = dealt(plans.run_job(spark, spec))
    assert [r for p in parts for r in p] == [r for p in few for r in p]
    size = [sum(len(x) for r in p for x in r) for p in parts]
    assert max(size) < 3 * 20_000 or job == "srt" and max(size) < sum(size) / 4

def test_a_cut_range_has_no_more_parts_than_it_needs_and_few_files(spark, monkeypatch):
    written = []
    monkeypatch.setattr(O, "stored", lambda df, name, f=O.stored: written.append(f(df, name)) or written[-1])
    kv = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").cast("string").alias("value"))
    cut = by_split_points(kv, ["a"], 100)
    assert cut.rdd.getNumPartitions() == 201  # one for the empty range
    counted = O.numbered(cut.sortWithinPartitions("key", "value").withColumn("part", F.spark_partition_id()), tasks=3).collect()
    assert len(written[-1].inputFiles()) <= 3
    rows = sorted((r.rn, r.part, r.key, r["value"]) for r in counted)
    assert [r[0] for r in rows] == list(range(1, 20_001)) and [r[1] for r in rows] == [1 + i // 100 for i in range(20_000)]
    assert [r[2:] for r in rows] == sorted((f"k{i % 7}", str(i)) for i in range(20_000))


# Plugins


PLUGIN = """
from quern.plans import python_job

def _map(document, line):
    yield from ((word, "1") for word in line.split() if len(word) > 3)

def _count(key, values):
    return str(sum(map(int, values)))

JOB = python_job(_map, _count, combine=_count, by_line=True)
"""


def test_a_job_from_a_file_of_the_users(spark, tmp_path):
    (tmp_path / "longwords.py").write_text(PLUGIN)
    (tmp_path / "data").write_text("some words and\nsome more\n")
    run = ["run", "longwords", str(tmp_path / "data"), "--plugin", str(tmp_path / "longwords.py"), "--single", "--output"]
    for out in ("o", "again"):  # a plugin may be loaded again
        main([*run, str(tmp_path / out)])
        assert [p.read_text() for p in (tmp_path / out).glob("part-*")] == ["more: 1\nsome: 2\nwords: 1\n"]


def test_a_job_from_a_module_by_name(spark, tmp_path, monkeypatch):
    (tmp_path / "quern_test_plugin.py").write_text(PLUGIN)
    (tmp_path / "data").write_text("some words")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert plugins.load("quern_test_plugin") == "quern_test_plugin"
    assert result(spark, "quern_test_plugin", tmp_path / "data") == {"some": "1", "words": "1"}


def test_what_is_wrong_with_a_plugin_is_told(spark, tmp_path, capsys):
    (tmp_path / "broken.py").write_text("def :")
    (tmp_path / "nameless.py").write_text("job = 1")
    (tmp_path / "wrong.py").write_text("JOB = 'a text'")
    (tmp_path / "wc.py").write_text(PLUGIN)
    cases = [("no_such_module", ImportError, "cannot open"), (f"{tmp_path}/absent.py", ImportError, "cannot open"), (f"{tmp_path}/broken.py", ImportError, "cannot open"), (f"{tmp_path}/nameless.py", AttributeError, "no JOB"), (f"{tmp_path}/wrong.py", TypeError, "not a Job"), (f"{tmp_path}/wc.py", ValueError, "exists already")]
    for plugin, kind, told in cases:
        with pytest.raises(kind, match=told):
            plugins.load(plugin)
        with pytest.raises(SystemExit):
            main(["run", "wc", "x", "--plugin", plugin, "--output", "y"])
        assert told in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["run", "nothing", "x", "--output", "y"])
    assert "no such job" in capsys.readouterr().err


# Folds


def test_a_mean_is_folded_in_the_task(spark):
    rows = [(f"k{i % 7}", str(i * i % 101)) for i in range(3000)] + [("hot", "5")] * 2000
    kv = spark.createDataFrame(rows, "key string, value string").repartition(9)
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(int(v))
    means = {k: sum(v) / len(v) for k, v in want.items()}
    for held in (1, 5, 200_000):
        folded = fold_by_key(kv, queries.MEAN, held)
        assert {r.key: float(r.value) for r in folded.collect()} == means
    plan = folded._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Pandas" not in plan
    assert fold_by_key(kv.filter("false"), queries.MEAN).count() == 0


def test_states_of_a_key_over_many_batches(spark):
    kv = spark.range(4000).select(F.lit("only").alias("key"), F.col("id").cast("string").alias("value")).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [float(r.value) for r in fold_by_key(kv, queries.MEAN, 1).collect()] == [1999.5]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_job_of_a_fold(spark, tmp_path):
    (tmp_path / "f").write_text("aa b\naaa bb")
    plans.JOBS.pop("lengths", None)
    plans.register("lengths", fold_job(lambda d, t: ((w[0], str(len(w))) for w in t.split()), queries.MEAN, by_line=True))
    assert result(spark, "lengths", tmp_path / "f") == {"a": "2.5", "b": "1.5"}
    assert isinstance(queries.MEAN.step(pa.table({"key": ["a"], "value": ["1"]})), pa.Table)


# Handles


def slow_job(seconds):
    def pairs(document, line):
        time.sleep(seconds)
        return [(line, document)]

    return plans.Job(lambda spark, spec: storage.stored(plans.map_documents(storage.stored(sources.contents(spark, list(spec.inputs), True), "slow"), "document", "contents", pairs), "slow"), lambda kv: kv)


def test_two_jobs_at_a_time_and_one_that_is_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda s: str(tmp_path / "shared"))
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(f"x {name} x")
    plans.JOBS.pop("slow", None)
    plans.register("slow", slow_job(60))
    stopped = handles.start(spark, plans.JobSpec("slow", (str(tmp_path / "c"),)), str(tmp_path / "out-c"))
    two = [handles.start(spark, plans.JobSpec("wc", (str(tmp_path / n),)), str(tmp_path / f"out-{n}"), single=True) for n in "ab"]
    for n, job in zip("ab", two, strict=True):
        out = job.wait(60)
        assert job.done() and [p.read_text() for p in (tmp_path / f"out-{n}").glob("part-*")] == [f"{n}: 1\nx: 2\n"] and out.endswith(f"out-{n}")
    with pytest.raises(TimeoutError):
        stopped.wait(0.1)
    begun = time.time()
    stopped.cancel()
    assert stopped.done() and time.time() - begun < 30
    with pytest.raises(CancelledError):
        stopped.wait()
    assert not (tmp_path / "shared").exists() or not list((tmp_path / "shared").iterdir())


def test_a_jobs_error_is_raised_by_wait(spark, tmp_path):
    job = handles.start(spark, plans.JobSpec("wc", (str(tmp_path / "absent"),)), str(tmp_path / "o"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        job.wait(60)
    with pytest.raises(KeyError):
        handles.start(spark, plans.JobSpec("nothing", ("x",)), "y")
