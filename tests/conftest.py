import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4,3]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(pdf):
    """Rows of a pandas frame as sorted text, columns by name; floats to nine places."""
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def agrees(spark, duck):
    def check(query, sql):
        got, want = query(spark, str(DATA)).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        # Whole numbers with nulls are floats in one and not in the other.
        assert canonical(got.convert_dtypes()) == canonical(want.convert_dtypes())

    return check
