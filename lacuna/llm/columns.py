"""Ids on their way through pandas, and names for inner columns.

pandas has no nulls among whole numbers: one null turns a batch's longs into doubles, which changes those beyond 2^53. Ids of whole numbers
(and booleans) therefore travel as text and are cast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Carried:
    """A column of ``df`` under the name ``name`` for a pandas worker: ``sent`` to it, with type ``kind`` there, and ``back`` from it."""

    def __init__(self, df: DataFrame, column: str, name: str = "id"):
        real = df.schema[column].dataType
        textual = isinstance(real, (T.IntegralType, T.BooleanType))
        self.sent: Column = (F.col(column).cast("string") if textual else F.col(column)).alias(name)
        self.kind: str = "string" if textual else real.simpleString()
        self.back: Column = F.col(name).cast(real).alias(column)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
