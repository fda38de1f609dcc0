"""Incremental sampling: new files of a corpus folder are sampled as they arrive, each once.

A file stream finds the new files; each micro-batch draws from their cells on top of the manifest so far. Batches
are numbered, and a batch that is repeated after a failure writes over its own part, so rows are not drawn twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lacuna.operators import profile, sampling
from lacuna.plans.runner import exists
from lacuna.sources.corpus import cells_of_files

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def sample_new_files(spark: SparkSession, folder: str, manifest_dir: str, checkpoint: str, files_per_batch: int = 1000, **options) -> StreamingQuery:
    """Start a query that samples all files that are new since its last run, and then ends.

    ``options`` go to ``build_manifest``. The manifest is a table partitioned by ``batch``.
    """
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).load(folder)
    low = options.get("min_n") or options.get("n", 5)

    def draw(files: DataFrame, batch: int) -> None:
        named = files.withColumn("file_basename", F.element_at(F.split("path", "/"), -1)).select("file_basename", "content")
        cells, _ = cells_of_files(named)
        masked = profile.with_mask(cells).persist()
        old = spark.read.parquet(manifest_dir).where(F.col("batch") < batch).drop("batch") if exists(spark, f"{manifest_dir}") else None
        eligible = profile.eligibility(profile.column_profile(masked), min_n=low).where("reason is null")
        lists = profile.co_missing_lists(profile.co_missing_classes(masked))
        first = 0 if old is None else sampling.next_sample_id(old)
        sampling.build_manifest(masked, eligible, lists, old, first_id=first, **options).write.mode("overwrite").parquet(f"{manifest_dir}/batch={batch}")
        masked.unpersist()

    return stream.writeStream.foreachBatch(draw).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
