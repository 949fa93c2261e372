"""Blocks of texts, and operators beside one another in one session."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from conftest import DATA
from helpers import docs, prose
from pyspark.sql import functions as F

from quern.llm import _blocks, queries, suffix_dedup
from quern.llm._blocks import unpack


@pytest.mark.parametrize("partitions", ["3", "100001"])
def test_blocks_meet_what_is_asked_for_them_whatever_the_shuffle_partitions(spark, partitions):
    texts = prose(random.Random(1), 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        blocks = _blocks.pack(docs(spark, texts).repartition(3), "text", 500)
        asked = blocks.select(F.col("block").alias("asker"), F.length("rows").alias("size"))
        met = blocks.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(lambda a, b: pa.table({"n": [a.num_rows * b.num_rows], "rows": [sum(x.num_rows for r in a.column("rows") for x in unpack(r.as_py()))]}), "n long, rows long")
        told = met.collect()
        assert sum(r.rows for r in told) == 50 and {r.n for r in told} == {1} and len(told) >= 3
        # Blocks stay in their files: only the other side is dealt anew, at most.
        plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange") <= 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_files_of_blocks_go_by_the_bytes_of_text(spark, monkeypatch):
    df = docs(spark, ["x" * 1000] * 20 + [None])
    assert _blocks.n_files(df, "text") == 1 and _blocks.n_files(df.filter("false"), "text") == 1
    monkeypatch.setattr(_blocks, "FILE_BYTES", 3000)
    assert _blocks.n_files(df, "text") == 7
    monkeypatch.setattr(_blocks, "MOST_FILES", 5)
    assert _blocks.n_files(df, "text") == 5


def test_operators_at_a_time_leave_one_anothers_tables_alone(spark):
    """Both write tables and delete those they are done with, while the other one runs."""
    run = lambda name: sorted(map(tuple, queries.queries()[name](spark, str(DATA)).collect()))
    names = ["op8_quality", "op10_jaccard_join"]
    with ThreadPoolExecutor(2) as pool:
        beside = list(pool.map(run, names * 2))
    assert beside[:2] == beside[2:] == [run(n) for n in names]


def test_repeats_in_a_text_longer_than_its_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(2)
    text = " ".join(prose(rng, 200))
    passage = text[3000:3700]
    rows = [(1, text), (2, text[:500] + "#" * 3 + passage + "!" + "".join(rng.choice("abcdef") for _ in range(5000))), (3, None), (4, passage * 3)]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: set[bytes] = set()
    for i, t in rows:
        raw = (t or "").encode()
        gone = set()
        for at in range(len(raw) - 99):
            piece = hashlib.md5(raw[at : at + 100]).digest()
            if piece in seen:
                gone.update(range(at, at + 100))
            seen.add(piece)
        assert got[i] == bytes(b for k, b in enumerate(raw) if k not in gone)
