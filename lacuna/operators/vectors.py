"""Vectors as arrays: normalising, pooling, padding, and the wide prediction dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    from lacuna.functions.text import let

    return let(F.struct(v.alias("v"), _norm(v).alias("n")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))


def pad(v: Column, size: int) -> Column:
    """Zeros appended up to ``size``; a vector that is longer is an error."""
    checked = F.when(F.size(v) > size, F.raise_error(F.lit(f"a vector is longer than {size}")).cast("array<double>")).otherwise(v.cast("array<double>"))
    return F.concat(checked, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(v)))


def mean_pool(context: Column, name: Column, size: int) -> Column:
    """The normalised mean of the normalised context vector and the padded, normalised name vector."""
    return l2_normalize(F.zip_with(l2_normalize(context), pad(l2_normalize(name), size), lambda a, b: (a + b) / 2))


def group_mean(df: DataFrame, keys: list[str], vector_col: str, out_col: str = "mean") -> DataFrame:
    """The mean vector of each group, by position: partial sums travel, not vectors."""
    each = df.select(*keys, F.posexplode(vector_col).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return each.groupBy(*keys).agg(F.transform(listed, lambda s: s["x"]).alias(out_col))


def resolve_positions(wanted: list[int] | None, n: Column) -> Column:
    """Layer or head numbers below ``n``, counted from the end if negative; all of them if none are named. Others are an error."""
    if wanted is None:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(F.array(*[F.lit(k) for k in wanted]).cast("array<int>"), lambda k: F.when(k < 0, k + n).otherwise(k))
    wrong = F.exists(found, lambda k: (k < 0) | (k >= n))
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"positions {wanted} of "), n.cast("string"))).cast("array<int>")).otherwise(found)


def half_precision(x: Column) -> Column:
    """The half-precision number nearest to a double, of two equally near ones the even one; infinite from 65520 on."""
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-14.0))  # log2 of 0 is null
    near = F.rint(x / F.pow(F.lit(2.0), exponent - 10)) * F.pow(F.lit(2.0), exponent - 10)
    return F.when(size >= 65520, F.when(F.isnan(x), x).otherwise(F.signum(x) * float("inf"))).otherwise(near)


def embedding_names(size: int) -> list[str]:
    """emb_000 and so on, as wide as the last number but three digits at least."""
    width = max(3, len(str(size - 1)))
    return [f"emb_{i:0{width}d}" for i in range(size)]


def prediction_dataset(embedded: DataFrame, size: int, vector_col: str = "embedding", shard: str | None = None) -> DataFrame:
    """The wide table: provenance, y from the missing kind, the row's place in its group, and a float column per dimension.

    Groups are within a ``shard``, a column that then comes last.
    """
    wrong = F.size(vector_col) != size
    vector = F.when(wrong, F.raise_error(F.lit(f"an embedding has not the size {size}")).cast("array<double>")).otherwise(F.col(vector_col).cast("array<double>"))
    more = [shard] if shard else []
    group = Window.partitionBy("table_id", "column_type", *more).orderBy("sample_id")
    rows = embedded.withColumns({"row_in_table": F.row_number().over(group).cast("long") - 1, "__v": vector})
    return rows.select(
        "sample_id", "table_id", "column_type", "row_idx", "row_in_table", (F.col("missing_kind") != "present").cast("int").alias("y"), "special_token",
        *[F.get("__v", F.lit(i)).cast("float").alias(name) for i, name in enumerate(embedding_names(size))], *more,
    )
