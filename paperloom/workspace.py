"""The shared folder: where it is, tables written there, lineage cut there, and clearing what a run has left."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_left: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where that is unset, a local master gets a temporary folder of its own; on a cluster it is an error, since every
    machine would see a folder of its own there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: this needs a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        d = _own_dir[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; ``clean_up`` removes it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _left.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: an eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside: an executor and its Python workers hold a batch each.

    For rows with whole texts; frames that are computed later have the session's own batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextlib.contextmanager
def tasks_of_cores(spark: SparkSession) -> Iterator[None]:
    """No more shuffle partitions than cores for what starts inside: each partition of a stream's state costs every batch a task and its files."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def last_path() -> str:
    """The path made last."""
    return _left[-1]


def mark() -> int:
    """How many paths are held just now; for ``clean_up``."""
    return len(_left)


def clean_up(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the paths made since ``mark()`` but for ``keep``. Frames that still read them must not be used any more."""
    gone = [p for p in _left[since:] if p not in keep]
    _left[since:] = [p for p in _left[since:] if p in keep]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
