"""Shared-folder tables that cut lineage.

Iterative operators write their state as Parquet below the folder named by
``spark.checkpoint.dir`` and read it back.  Unlike a local checkpoint the files
survive the loss of any executor.  Where the setting is missing a temporary
folder of the driver is used in local mode; on a cluster that is an error,
since executors would each write to their own disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FALLBACK: dict[str, str] = {}
_SCOPES: list[Scope] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a driver-local one only in local mode without a setting."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="kinweave-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kinweave-{tag}-{uuid.uuid4().hex}"


class Stored:
    """A written table: ``df`` reads it, ``drop()`` removes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame, tag: str = "table"):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, tag)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        if _SCOPES:
            _SCOPES[-1].made.append(self)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """The tables written within a ``scratch`` block."""

    def __init__(self) -> None:
        self.made: list[Stored] = []
        self.kept: list[Stored] = []

    def keep(self, df: DataFrame, tag: str = "table") -> DataFrame:
        """Write a result that outlives the block (it belongs to the block around, if there is one)."""
        out = Stored(df, tag)
        self.made.remove(out)
        self.kept.append(out)
        return out.df


@contextmanager
def scratch() -> Iterator[Scope]:
    """All tables written in the block are removed at its end, but those that ``keep`` wrote."""
    scope = Scope()
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.pop()
        for table in scope.made:
            table.drop()
        if _SCOPES:
            _SCOPES[-1].made.extend(scope.kept)


def materialize(df: DataFrame, tag: str = "table", release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads the files.

    ``release``: what was shuffled to make it is removed once it is written, not
    when the driver happens to collect garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true" if release else before)
    try:
        return Stored(df, tag).df
    finally:
        conf.set(CLEANUP, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
