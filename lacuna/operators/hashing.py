"""The built-in encoder: feature hashing of words as joins and sums, without a model and without Python workers.

A word's place and sign come from its md5, which every engine has. Words are exploded, their signs summed by place while the vector is sparse (partial sums before the
shuffle), and each distinct input gets one vector, which is joined back to the rows that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import words


def place(word: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % size).cast("int")


def sign(word: Column) -> Column:
    return F.when(F.substring(F.md5(word), 9, 1) < "8", 1).otherwise(-1)


def _joined(df: DataFrame, key: Column, inputs: list[Column], sparse, size: int, out_col: str, unit: bool) -> DataFrame:
    """``df`` with the dense vectors of its distinct keys; ``sparse`` makes (__key, place, x) of (__key, inputs...)."""
    keyed = df.withColumn("__key", key)
    once = keyed.select("__key", *inputs).dropDuplicates(["__key"])
    sums = sparse(once).where("x <> 0").withColumn("x", F.col("x").cast("double"))
    vectors = sums.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    shown = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / (F.col("norm") if unit else F.lit(1.0)), F.lit(0.0)).cast("float"))
    found = vectors.select("__key", shown.alias("__vector"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return keyed.join(found, "__key", "left").withColumn(out_col, F.coalesce("__vector", zeros)).drop("__key", "__vector")


def hash_texts(df: DataFrame, text_col: str, size: int, out_col: str = "embedding") -> DataFrame:
    """Add the vector of a text: signed sums of its words, of unit length; a text without words (or null) is zero."""

    def sparse(once: DataFrame) -> DataFrame:
        word = once.select("__key", F.explode(words(F.col("__text"))).alias("w"))
        return word.groupBy("__key", place(F.col("w"), size).alias("place")).agg(F.sum(sign(F.col("w"))).alias("x"))

    return _joined(df, F.md5(F.coalesce(F.col(text_col), F.lit(""))), [F.coalesce(F.col(text_col), F.lit("")).alias("__text")], sparse, size, out_col, unit=True)


def hash_tables(df: DataFrame, size: int, out_col: str = "embedding") -> DataFrame:
    """Add the vector of a row prepared as a table (``cells`` of header and cell, ``target_position``).

    A cell's vector is the mean of its words', headers included; an empty cell is zero. A row's is its target's, or the mean of all its cells if
    the target was removed.
    """

    def sparse(once: DataFrame) -> DataFrame:
        cells = once.select("__key", F.size("__cells").alias("n_cells"), "__target", F.posexplode("__cells").alias("at", "c")).where("__target is null or at = __target")
        named = cells.where("coalesce(c.cell, '') <> ''").select("__key", "at", F.when(F.col("__target").isNull(), F.col("n_cells")).otherwise(1).alias("share"), words(F.concat_ws(" ", "c.header", "c.cell")).alias("w"))
        word = named.select("__key", "at", "share", F.size("w").alias("n"), F.explode("w").alias("w"))
        # Whole numbers are summed within a cell first, so that the order of rows does not show in the digits.
        of_cell = word.groupBy("__key", "at", "share", "n", place(F.col("w"), size).alias("place")).agg(F.sum(sign(F.col("w"))).alias("s"))
        return of_cell.groupBy("__key", "place").agg(F.sum(F.col("s") / F.col("n") / F.col("share")).alias("x"))

    key = F.md5(F.to_json(F.struct("cells", "target_position")))
    return _joined(df, key, [F.col("cells").alias("__cells"), F.col("target_position").alias("__target")], sparse, size, out_col, unit=False)
