"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("open_scratches", default=())


class Scratch:
    """The paths that fresh_dir() gives inside a ``with`` block, which may be entered again and again; drop() deletes what is there once nothing reads it any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.tables: list[str] = []
        self.spark: SparkSession | None = None
        self._tokens: list = []

    def __enter__(self) -> Scratch:
        self._tokens.append(_OPEN.set((*_OPEN.get(), self)))
        return self

    def __exit__(self, *_) -> None:
        _OPEN.reset(self._tokens.pop())

    def drop(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        while self.paths:
            drop_dir(self.spark, self.paths.pop())


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without the setting: it gets a folder of its own, which goes when Python ends."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="meshfront-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.sparkContext.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scratch in _OPEN.get():
        scratch.spark = spark
        scratch.paths.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def publish(spark: SparkSession, own: str, path: str) -> bool:
    """Rename the written folder ``own`` to ``path``, where only this function puts folders, unless one is there already; say whether it was done. ``own`` is gone either way.

    ``own`` must be a hidden name (``_...``): a store that finds ``path`` there puts ``own`` inside it, where readers pass it over until it is deleted.
    """
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (own, path))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    late = jvm.org.apache.hadoop.fs.Path(target, source.getName())
    won = not files.exists(target) and files.rename(source, target) and not files.delete(late, True)
    if not won:
        files.delete(source, True)
        if not files.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
            raise OSError(f"{path} could not be published")
    return won


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a path that fresh_dir() gave, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of a table's files: another value if the table was written anew."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(target)))


_TOGETHER: dict = {"lock": threading.Lock(), "depth": 0, "before": {}}
#: Joins by one key; and a task that writes few buckets needn't sort its rows by bucket.
_SET = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "2"}


@contextmanager
def together(spark: SparkSession):
    """Joins planned within take sides that lie in the same buckets by one of the join's keys as they are; else Spark shuffles both by all keys."""
    own = _TOGETHER
    with own["lock"]:
        if not own["depth"]:
            own["before"] = {k: spark.conf.get(k) for k in _SET}
            for k, v in _SET.items():
                spark.conf.set(k, v)
        own["depth"] += 1
    try:
        yield
    finally:
        with own["lock"]:
            own["depth"] -= 1
            if not own["depth"]:
                for k, v in own["before"].items():
                    spark.conf.set(k, v)


#: Stages are written once and read a few times, so size counts more than speed.
CODEC = "zstd"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table: later jobs neither recompute it nor depend on one executor."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", CODEC).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def materialize_by(df: DataFrame, name: str, key: str, buckets: int | None = None, lies: bool = False) -> DataFrame:
    """As materialize(), but the written table is bucketed by ``key``: a join on it shuffles the other side alone, however often the table is joined, and tables with as many buckets by one key meet without a shuffle.

    Buckets are as many as shuffle partitions if not given, one file each. Rows that come from a table with the same buckets aren't shuffled again; ``lies`` says so of rows of which Spark can't tell. Spark keeps bucketing with a table's name only, so the files are known to the session's catalog until they are dropped.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    table, buckets = f"meshfront_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with together(spark):
        rows = (df if lies else df.repartition(buckets, key)).write.format("parquet").option("compression", CODEC).bucketBy(buckets, key)
        # Rows that lie in their buckets come block by block; they are not sorted again.
        (rows if lies else rows.sortBy(key)).option("path", path).saveAsTable(table)
    for scratch in _OPEN.get():
        scratch.tables.append(table)
    out = spark.table(table)
    out.stored_at, out.stored_as, out.buckets = path, table, buckets
    return out


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    if table := getattr(df, "stored_as", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path := getattr(df, "stored_at", None):
        drop_dir(df.sparkSession, path)
