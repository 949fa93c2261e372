"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Of each application, the paths that it has made and the table at each; for clear() alone.
_made: dict[str, dict[str, str | None]] = {}
_lock = threading.Lock()
#: The innermost scope of the call that runs; threads start without one, so none sees what another makes.
_scope: ContextVar[Scope | None] = ContextVar("quern-scope", default=None)
#: Bytes of a row group, which one task reads whole: with Spark's 128 MB each thread that reads takes room for as many.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of rows that an executor and its Python workers exchange at a time, where a step says so, and Spark's setting of it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of each session, how many calls want small batches just now, and whether the setting is theirs.
_small: dict[SparkSession, tuple[int, bool]] = {}


class Scope:
    """What a call writes to the shared folder, so that it can delete that and nothing else.

        with Scope(spark) as own:
            a = stored(x, "a")
            b = stored(a.join(y, "k"), "b")
            own.drop(b)  # a goes

    Tables of other threads, and those made before, are not in it. What is left at the end passes to the scope around it;
    if the call fails, all of it is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, {}

    def __enter__(self) -> Scope:
        self.outer = _scope.get()
        self.token = _scope.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _scope.reset(self.token)
        if kind is not None:
            self.drop()
        if self.outer is not None:
            self.outer.made |= self.made

    def drop(self, *keep: DataFrame) -> None:
        """Delete what was made in this scope, but for keep (what stored returned). Nothing may still read it."""
        kept = {getattr(df, "_stored_at", None) for df in keep}
        gone = {path: table for path, table in self.made.items() if path not in kept}
        self.made = {path: table for path, table in self.made.items() if path in kept}
        _delete_all(self.spark, gone)


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary folder of our own if all of Spark runs in
    one process; on a cluster, whose machines would not see each other's files, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quern-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/quern-{app}"


def _note(spark: SparkSession, path: str, table: str | None = None) -> None:
    with _lock:
        _made.setdefault(spark.sparkContext.applicationId, {})[path] = table
    if scope := _scope.get():
        scope.made[path] = table


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _note(spark, path)
    return path


def new_table(spark: SparkSession, kind: str) -> tuple[str, str]:
    """Name and path of a catalog table of this application."""
    app = re.sub(r"\W", "_", spark.sparkContext.applicationId)
    name = f"quern_{kind}_{app}_{uuid.uuid4().hex}".lower()
    path = f"{scratch_dir(spark)}/{name}"
    _note(spark, path, name)
    return name, path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage: executors may go, and no later stage computes df again. It also fixes values
    that depend on how rows were dealt to tasks, such as row numbers.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for Scope.drop
    return out


def _delete_all(spark: SparkSession, made: dict[str, str | None]) -> None:
    for path, table in made.items():
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        _delete(spark, path)
        with _lock:
            _made.get(spark.sparkContext.applicationId, {}).pop(path, None)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, whichever thread did. Results that still read
    it must be done."""
    _delete_all(spark, dict(_made.get(spark.sparkContext.applicationId, {})))
    _delete(spark, scratch_dir(spark))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile exchange rows with Python in batches of about BATCH_BYTES, unless the session sets a size itself.

    Spark's limits are 10,000 rows and 64 MB: an executor holds a batch several times outside of its heap, where the room
    stays taken, and the more rows a task has, the more that is. The session is as before when the last of several such
    calls is done; results are the same whatever the size."""
    with _lock:
        calls, ours = _small.get(spark, (0, False))
        if not calls:
            ours = spark.conf.get(BATCH_SETTING, None) is None
            if ours:
                spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        _small[spark] = calls + 1, ours
    try:
        yield
    finally:
        with _lock:
            calls, ours = _small.pop(spark)
            if calls > 1:
                _small[spark] = calls - 1, ours
            elif ours:
                spark.conf.unset(BATCH_SETTING)
