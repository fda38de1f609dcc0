"""External lists of occurrences: CSV files whose lines have an order, of which the last entry of a cell counts."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.corpus import missing_path

KEYS = ["file", "column", "row_idx"]
_VALUES = ["matched_pattern", "original_value"]
#: Quotes are doubled and values may hold line feeds, as CSV files usually have it.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_occurrences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected) of a list at ``path``, found by the names of its header; an absent list is empty, with a warning.

    Entries: file, column, row_idx, matched_pattern, original_value, and ``place``, which orders them as their lines stand: by file name, then by position.
    Rejected: the lines, as JSON, without a file, a column or a whole number as row_idx.
    """
    schema = "file string, column string, row_idx long, matched_pattern string, original_value string, place struct<path: string, start: long, line: long>"
    try:
        found = spark.read.options(**CSV).csv(path)
    except Exception as error:
        if not missing_path(error):
            raise
        warnings.warn(f"there is no occurrence list at {path}; labels come from the rules alone", stacklevel=2)
        return spark.createDataFrame([], schema), spark.createDataFrame([], "place struct<path: string, start: long, line: long>, entry string")
    if lost := {*KEYS, "original_value"} - set(found.columns):
        raise ValueError(f"the occurrence list at {path} has no column {', '.join(sorted(lost))}")
    # Numbers rise with the lines of a split; a list is split nowhere but at its files.
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    values = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in _VALUES]
    rows = found.select("file", "column", F.col("row_idx").try_cast("double").alias("number"), *values, place.alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in found.columns])).alias("entry"))
    sound = F.coalesce(F.col("file").isNotNull() & F.col("column").isNotNull() & (F.col("number") == F.floor("number")), F.lit(False))
    entries = rows.where(sound).select("file", "column", F.col("number").cast("long").alias("row_idx"), *_VALUES, "place")
    return entries, rows.where(~sound).select("place", "entry")


def last_entries(found: DataFrame) -> DataFrame:
    """(file_basename, column, row_idx, occurrence): one original value for each cell, of its last entry; without a ``place`` the greatest value counts."""
    value = F.max_by("original_value", "place") if "place" in found.columns else F.max("original_value")
    return found.groupBy(F.col("file").alias("file_basename"), "column", "row_idx").agg(value.alias("occurrence"))
