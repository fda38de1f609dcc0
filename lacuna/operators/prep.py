"""Encoder input: sampled rows of the cell relation as sentences or as tables of strings, under ablations.

The target is resolved by position before anything is dropped. Non-target missing cells become the
empty token (sentences) or "n/a" (tables); the target cell becomes the mask token or is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.lexicon import EMPTY_SENTINEL, EMPTY_TOKEN, MASK_TOKEN
from lacuna.functions.missing import format_cell, with_missing
from lacuna.functions.text import normalize

Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class Ablation:
    """header: preserve, strip or only_target; target: mask, remove or meanpool."""

    id: str
    header: str = "preserve"
    target: str = "mask"
    co_missing_drop: bool = False

    def __post_init__(self) -> None:
        if self.header not in ("preserve", "strip", "only_target") or self.target not in ("mask", "remove", "meanpool"):
            raise ValueError(f"ablation {self.id!r}: unknown header {self.header!r} or target {self.target!r}")


ABLATIONS = (
    Ablation("default"),
    Ablation("without_header", header="strip"),
    Ablation("without_target", target="remove"),
    Ablation("only_target", header="only_target"),
    Ablation("meanpool_target", target="meanpool"),
    Ablation("co_missing_drop", co_missing_drop=True),
)


def canonicalize_missing(cells: DataFrame, sentinel: str = EMPTY_SENTINEL, skip_columns: tuple[str, ...] = ()) -> DataFrame:
    """Missing cells' values replaced by the sentinel, but for the skipped columns."""
    skip = F.col("column").isin(*skip_columns) if skip_columns else F.lit(False)
    replaced = ~skip & F.col("__missing")
    marked = with_missing(cells, out="__missing")
    return marked.withColumns({"value": F.when(replaced, sentinel).otherwise(F.col("value")), "is_null": ~replaced & F.col("is_null")}).drop("__missing")


def sampled_cells(manifest: DataFrame, masked: DataFrame) -> DataFrame:
    """All cells of the sampled rows, a row per sample and column, with ``is_target`` and ``co_missing``."""
    keys = ["table_id", "row_idx"]
    wanted = manifest.select("sample_id", *keys, "column_type", "target_col", "target_col_idx", "y", "missing_kind", "special_token", "co_missing_columns")
    joined = masked.join(wanted, keys)
    dropped = F.array_contains(F.from_json(F.coalesce("co_missing_columns", F.lit("[]")), "array<string>"), F.col("column"))
    return joined.withColumns({"is_target": F.col("col_idx") == F.col("target_col_idx"), "co_missing": dropped & (F.col("col_idx") != F.col("target_col_idx"))})


def _rows(cells: DataFrame, part: Column, names: Rule) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", part.alias("part")))), lambda x: x["part"])
    keys = ["sample_id", "table_id", "row_idx", "column_type", "y", "missing_kind", "special_token", *(c for c in ("shard",) if c in cells.columns)]
    target = F.max(F.when(F.col("is_target"), names(F.col("column")))).alias("target_name")
    return cells.groupBy(*keys).agg(listed.alias("parts"), target)


def _used(cells: DataFrame, ablation: Ablation) -> DataFrame:
    return cells.where(~F.col("co_missing")) if ablation.co_missing_drop else cells


def sentences(
    cells: DataFrame, ablation: Ablation, *, names: Rule = normalize, shown: Callable[[Column, Column, Column], Column] = format_cell, mask_token: str = MASK_TOKEN, empty_token: str = EMPTY_TOKEN,
) -> DataFrame:
    """One sentence per sample: ``name: value`` joined by commas; ``strip`` leaves names out, ``only_target`` numbers them.

    Columns are numbered by their place among the columns that are used, the target included. ``names`` makes a name of a header,
    ``shown`` a text of a present cell's (value, number, is_null).
    """
    used = _used(cells, ablation)
    number = F.col("value").try_cast("double")
    value = F.when(F.col("is_target"), mask_token).when(F.col("missing"), empty_token).otherwise(shown(F.col("value"), F.when(F.col("is_numeric"), number), F.col("is_null")))
    parts = F.struct(value.alias("value"), names(F.col("column")).alias("name"), F.col("is_target").alias("target"))
    out = _rows(used, parts, names)

    def segment(x: Column, i: Column) -> Column:
        if ablation.header == "strip":
            name = F.lit("")
        elif ablation.header == "only_target":
            name = F.when(x["target"], F.concat(x["name"], F.lit(": "))).otherwise(F.concat(F.lit("c"), i.cast("string"), F.lit(": ")))
        else:
            name = F.concat(x["name"], F.lit(": "))
        text = F.concat(name, x["value"])
        return F.when(x["target"], None).otherwise(text) if ablation.target == "remove" else text

    return out.withColumn("sentence", F.array_join(F.array_compact(F.transform("parts", segment)), ", ")).drop("parts")


def tables(cells: DataFrame, ablation: Ablation, *, names: Rule = normalize, values: Rule = normalize, mask_token: str = MASK_TOKEN, empty: str = EMPTY_SENTINEL) -> DataFrame:
    """One row of (header, cell) per sample for table encoders; ``target_position`` is null if the target is removed.

    Cells and headers are in normal form, or as ``values`` and ``names`` make them; missing cells are "n/a"; numbers keep their text form.
    """
    used = _used(cells, ablation)
    value = F.when(F.col("is_target"), mask_token).otherwise(values(F.when(F.col("missing"), empty).otherwise(F.col("value"))))
    parts = F.struct(value.alias("cell"), names(F.col("column")).alias("header"), F.col("is_target").alias("target"))
    out = _rows(used, parts, names)
    kept = F.filter("parts", lambda x: ~x["target"]) if ablation.target == "remove" else F.col("parts")

    def renamed(x: Column, i: Column) -> Column:
        numbered = F.concat(F.lit("c"), i.cast("string"))
        header = x["header"] if ablation.header == "preserve" else numbered if ablation.header == "strip" else F.when(x["target"], x["header"]).otherwise(numbered)
        return F.struct(header.alias("header"), x["cell"].alias("cell"))

    position = F.lit(None).cast("int") if ablation.target == "remove" else F.array_position(F.transform("parts", lambda x: x["target"]), True).cast("int") - 1
    return out.withColumns({"cells": F.transform(kept, renamed), "target_position": position}).drop("parts")
