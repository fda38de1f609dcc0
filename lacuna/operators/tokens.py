"""Disguised tokens: the occurrence audit, its summary, and the manifest of unknown and not-applicable cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.missing import classify, classify_cell, token_group
from lacuna.functions.text import column_type, strip
from lacuna.operators import ranking
from lacuna.operators.occurrences import last_entries
from lacuna.operators.sampling import numbered, order_key
from lacuna.sources.staging import staged


#: Parts in which the present cells of a column are ranked.
PARTS = 64


def occurrences(cells: DataFrame) -> DataFrame:
    """A row per cell that literals, phrases or sentinels recognise, over all columns."""
    found = cells.withColumn("found", classify(F.col("value"), F.col("is_numeric"), F.col("is_null"))).where("found.kind is not null")
    return found.select(
        "table_id", F.col("file_basename").alias("file"), "column", "row_idx", F.col("value").alias("original_value"), F.lower(strip(F.col("value"))).alias("normalized_value"),
        F.col("found.label").alias("matched_pattern"), F.col("found.kind").alias("kind"),
    )


def occurrence_summary(found: DataFrame) -> DataFrame:
    """Counts by value, kind and pattern; most frequent first when ordered by n_occurrences."""
    keys = ["normalized_value", "kind", "matched_pattern"]
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_occurrences"), F.count_distinct("column").alias("n_columns"), F.count_distinct("file").alias("n_files"))


def with_occurrence_labels(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells with the original value of an occurrence list as ``occurrence``; of repeated entries the last counts, as ``last_entries`` has it."""
    return cells.join(last_entries(found), ["file_basename", "column", "row_idx"], "left")


def token_manifest(masked: DataFrame, lists: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """All disguised cells of the two token groups, and as many present cells of the same columns, if there are.

    Rows may be used for several columns, and no column is screened.
    """
    keys = ["table_id", "file_basename", "col_idx"]
    cell = classify_cell(F.col("value"), F.col("is_numeric"), F.col("is_null"))
    marked = masked.withColumn("cell", F.when(F.col("missing"), cell))
    wanted = F.col("missing") & (F.col("cell.missing_kind") == "disguised") & token_group(F.col("cell.special_token")).isNotNull()
    marked = marked.withColumn("wanted", F.coalesce(wanted, F.lit(False))).where("wanted or not missing")
    counts = staged(marked.where("wanted").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_wanted")), "token-counts")  # a row per column
    found = marked.join(counts, keys)
    key = order_key(seed, F.lit(0), "file_basename", "column", "row_idx")
    # A column's present cells are ranked in parts first; of each part no more than are wanted can be among the first of all.
    part = F.pmod(F.xxhash64("row_idx"), F.lit(PARTS))
    in_part = Window.partitionBy(*keys, "wanted", part).orderBy(key, "row_idx")
    found = found.withColumn("rank", F.when(~F.col("wanted"), F.row_number().over(in_part))).where("wanted or rank <= n_wanted")
    found = staged(found.drop("rank").withColumn("key", F.when(~F.col("wanted"), key)), "tokens")
    # Wanted cells by row, present ones by their random key; a column with very many of them spreads over tasks.
    found = ranking.numbered(found, [F.col("key"), F.col("row_idx")], by=[*keys, "wanted"], name="rank").where("wanted or rank <= n_wanted")
    out = numbered(staged(found, "ranked-tokens"), [F.col("col_idx"), F.col("wanted").desc(), F.col("rank")])
    out = out.join(lists.select("table_id", "col_idx", "co_missing_columns"), ["table_id", "col_idx"], "left") if lists is not None else out.withColumn("co_missing_columns", F.lit(None).cast("string"))
    return out.select(
        "sample_id", F.concat(F.lit("datasets/"), "file_basename").alias("file"), "file_basename", "table_id", column_type(F.col("column")).alias("column_type"), F.col("column").alias("target_col"),
        F.col("col_idx").alias("target_col_idx"), "row_idx", F.col("wanted").cast("int").alias("y"), F.col("wanted").alias("is_missing"),
        F.when(F.col("wanted"), "disguised").otherwise("present").alias("missing_kind"), F.col("cell.special_token").alias("special_token"), F.col("value").alias("original_value"),
        F.coalesce("co_missing_columns", F.lit("[]")).alias("co_missing_columns"), F.lit(seed).alias("random_state"),
    )


def token_group_counts(manifest: DataFrame) -> DataFrame:
    """Missing rows by token group."""
    return manifest.where("y = 1").groupBy(token_group(F.col("special_token")).alias("token_group")).agg(F.count(F.lit(1)).alias("n"))
