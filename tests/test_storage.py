import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern import storage


@pytest.fixture(autouse=True)
def made_here(monkeypatch):
    monkeypatch.setattr(storage, "_made", {})


def test_stored_tables_are_in_the_scratch_folder_and_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda s: str(tmp_path / "shared"))
    df = storage.stored(spark.range(3), "x")
    assert df.count() == 3 and list((tmp_path / "shared").rglob("*.parquet"))
    storage.clear(spark)
    assert not (tmp_path / "shared").exists()


def test_clear_leaves_tables_of_others_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda s: str(tmp_path / "shared"))
    spark.range(2).write.option("path", str(tmp_path / "other")).saveAsTable("quern_other")
    name, path = storage.new_table(spark, "kind")
    spark.range(2).write.option("path", path).saveAsTable(name)
    try:
        storage.clear(spark)
        assert spark.catalog.tableExists("quern_other") and not spark.catalog.tableExists(name)
        assert spark.table("quern_other").count() == 2
    finally:
        spark.sql("DROP TABLE quern_other")


def test_a_scope_drops_only_what_it_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda s: str(tmp_path / "shared"))
    left = lambda: sorted(p.name.split("-")[0] for p in (tmp_path / "shared").iterdir())
    before = storage.stored(spark.range(1), "before")
    with storage.Scope(spark) as outer:
        storage.stored(spark.range(2), "outer")
        with storage.Scope(spark) as inner:
            storage.stored(spark.range(2), "gone")
            kept = storage.stored(spark.range(3), "kept")
            inner.drop(kept)
            assert left() == ["before", "kept", "outer"]
        assert (before.count(), kept.count()) == (1, 3)
        outer.drop()  # what the inner scope has left is the outer one's
    assert left() == ["before"]


def test_a_scope_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda s: str(tmp_path / "shared"))
    with pytest.raises(ZeroDivisionError), storage.Scope(spark):
        storage.stored(spark.range(2), "half")
        raise ZeroDivisionError
    assert not list((tmp_path / "shared").iterdir())


def test_scopes_of_threads_leave_one_anothers_tables_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_dir", lambda s: str(tmp_path / "shared"))
    made, dropped = threading.Barrier(2, timeout=60), threading.Barrier(2, timeout=60)

    def work(i):
        with storage.Scope(spark) as own:
            mine = storage.stored(spark.range(i + 2), f"mine{i}")
            storage.stored(spark.range(9), f"gone{i}")
            made.wait()
            own.drop(mine)
            dropped.wait()
            return mine.count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, range(2))) == [2, 3]
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()) == ["mine0", "mine1"]


def test_scratch_without_a_checkpoint_folder_is_our_own(spark):
    assert storage.scratch_dir(spark) == storage.scratch_dir(spark)
    assert spark.sparkContext.applicationId in storage.scratch_dir(spark)


def session(folder, cluster="local[2]"):
    class Conf:
        def get(self, key, default=None):
            return folder if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

        class sparkContext:
            applicationId = "app"
            master = cluster

            @staticmethod
            def getConf():
                return Conf()

    return Session()


def test_scratch_is_where_the_session_says(tmp_path):
    assert storage.scratch_dir(session(str(tmp_path))) == f"{tmp_path}/quern-app"


@pytest.mark.parametrize("cluster", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(cluster):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_dir(session(None, cluster))


def test_small_batches_follow_bytes_and_leave_the_session(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def largest():
        return max(r.n for r in rows.mapInArrow(sizes, "n long").collect())

    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert largest() > 3 * storage.BATCH_BYTES
    with storage.small_batches(spark):
        with storage.small_batches(spark):
            assert largest() < 1.1 * storage.BATCH_BYTES
        assert largest() < 1.1 * storage.BATCH_BYTES
    assert spark.conf.get(storage.BATCH_SETTING, None) is None
    spark.conf.set(storage.BATCH_SETTING, "1000000")
    try:
        with storage.small_batches(spark):
            assert largest() < 1_100_000
        assert spark.conf.get(storage.BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(storage.BATCH_SETTING)


def test_row_groups_of_scratch_tables_are_small(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROW_GROUP_BYTES", 1 << 16)
    kept = storage.stored(spark.range(0, 20_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("x")), "groups")
    files = list(Path(kept._stored_at.removeprefix("file:")).glob("*.parquet"))
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > 4
    assert kept.distinct().count() == 20_000
