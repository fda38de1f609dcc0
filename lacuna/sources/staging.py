"""Relations that several parts of a plan read, written once to the folder that the cluster shares.

The folder is the one named by ``spark.checkpoint.dir``. Only where that is unset and Spark runs in a single local JVM is a
temporary folder used; on a cluster without the setting an error is raised. What is written survives the loss of
executors, its columns are pruned and its filters pushed down when it is read, and its size is known to the planner.
``scratch`` removes an operator's inner tables as soon as its result no longer reads them.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


class _Scopes(threading.local):
    """The open scopes of a thread, each with its tables (name, path)."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, str]]] = []


_SCOPES = _Scopes()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged relations of this application."""
    found, app, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId, spark.sparkContext.master
    if not found:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="lacuna-")
        found = _LOCAL[app]
    return f"{found.rstrip('/')}/lacuna-{app}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A scan of ``df`` as written to the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append((name, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Remove the tables written inside, but those whose names are in ``keep``; these go with the surrounding scope.

    Frames that read a removed table become invalid, so what the block returns may read kept tables only. Without a
    surrounding scope kept tables stay until ``drop_staged``.
    """
    _SCOPES.open.append([])
    try:
        yield
    finally:
        tables = _SCOPES.open.pop()
        for name, path in tables:
            if name not in keep:
                delete(spark, path)
        if _SCOPES.open:
            _SCOPES.open[-1].extend(t for t in tables if t[0] in keep)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove this application's folder; frames that read from it become invalid."""
    delete(spark, shared_dir(spark))
