"""The ledger of a run: what has been done to which piece of work, appended and never changed.

An entry has the keys of a piece, its ``state`` (done or failed), ``error`` and ``at``; of several entries of a piece the last counts. What is open is found by an anti-join,
so that a run can be resumed after any stop, and several runs can append to one ledger.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.corpus import read_optional

ENTRIES = "encoder string, ablation string, manifest string, shards int, shard int, state string, error string, at timestamp"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries at ``path``; none if there is no ledger yet."""
    return read_optional(spark, path, ENTRIES)


def append(spark: SparkSession, path: str, entries: list[dict]) -> None:
    """Append one entry for each piece that a job has settled."""
    now = dt.datetime.now(dt.UTC)
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    rows = [tuple({"error": None, "at": now, **e}[c] for c in names) for e in entries]
    if rows:
        spark.createDataFrame(rows, ENTRIES).coalesce(1).write.mode("append").parquet(path)


def latest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each piece after its last entry; of entries at one time, a failed one counts."""
    return entries.groupBy(*keys).agg(F.max(F.struct("at", "state")).alias("last")).select(*keys, F.col("last.state").alias("state"))


def open_work(wanted: DataFrame, entries: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """The pieces of ``wanted`` that are not done; failed ones only if they are to be tried again."""
    settled = latest(entries, keys)
    settled = settled.where("state = 'done'") if retry_failed else settled.where("state in ('done', 'failed')")
    return wanted.join(settled, keys, "left_anti")
