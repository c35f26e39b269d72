"""Cutting lineage with tables written to the cluster's shared folder, and clearing them away."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # application to the folder made for it, where the session names none
_marked: set[str] = set()
_local = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only where the session names none (a test on one machine) is a folder of our own used, and only if the
    master is local: on a cluster a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _own:
            own = tempfile.mkdtemp(prefix="verdigris-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own[app] = f"file://{own}"
        folder = _own[app]
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def app_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application's driver ends."""
    path = f"{shared_dir(spark)}/verdigris-{spark.sparkContext.applicationId}"
    if path not in _marked:
        p, fs = _path(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(path)
    return path


def _scopes() -> list[set[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def materialise(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, read column by column,
    and safe against a lost executor. It belongs to the innermost :func:`scratch` and goes with it. With ``by``, each value of
    that column has a folder of its own."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].add(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialise`, once nothing needs them."""
    path = df._scratch
    for scope in _scopes():
        scope.discard(path)
    _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised within are deleted at its end, but for those given to :func:`keep`.

    Operators work in one and keep their results; a caller who writes a query's result within one leaves nothing
    behind, and without one results stay until the application ends.
    """
    own: set[str] = set()
    _scopes().append(own)
    try:
        yield
    finally:
        _scopes().remove(own)
        for path in own:
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Hand a table from :func:`materialise` over to the scope around the innermost one."""
    scopes = _scopes()
    if scopes and df._scratch in scopes[-1]:
        scopes[-1].remove(df._scratch)
        if len(scopes) > 1:
            scopes[-2].add(df._scratch)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores where the files give fewer partitions than there are cores (one small file, one row
    group); a table of many splits passes unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
