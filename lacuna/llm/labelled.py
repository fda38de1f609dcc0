"""Labelled documents, whole or as bounded samples, and splits by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has the remainder ``fold``; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every labelled document outside the held-out fold with its whole text: ``id``, ``label`` and ``text``, one row an id.

    Ids with several labels count with the largest, ids with several texts with the least; null ids have no label.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.join(_known(labels, label_col, folds, held_out, id_col).toDF("id", "label"), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def _known(labels: DataFrame, label_col: str, folds: int, held_out: int, id_col: str) -> DataFrame:
    """The label of each id outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    return known.where(~in_fold("__id", folds, held_out)).groupBy("__id").agg(F.max("__label").alias("__label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, rows_per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows_per_class`` labelled documents of each class: ``id``, ``label`` and the whole ``text``.

    Documents of the held-out fold or with null ids are not drawn; the length of a text does not matter. The draw is
    by a hash of the id, so it is the same in every run; ids with several labels count with the largest, ids with
    several texts with the least. The ids drawn are at most twice ``rows_per_class``, which bounds what is broadcast, and the executors
    reduce each to one text however often an id is repeated.
    """
    known = _known(labels, label_col, folds, held_out, id_col).toDF("id", "label")
    drawn = [known.where(f"label = {k}").orderBy(F.xxhash64("id"), "id").limit(rows_per_class) for k in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for d in drawn for r in d.collect()], known.schema)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
