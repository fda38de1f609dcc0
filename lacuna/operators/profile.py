"""Column profiles, eligibility, audit reasons and co-missing columns over the cell relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.lexicon import AGGREGATE_CELL_PATTERN, BLOCKED_COLUMNS, INTERNAL_COLUMN_PATTERN, INTERNAL_COLUMN_PATTERN_STRICT
from lacuna.functions.missing import with_missing
from lacuna.functions.text import column_type
from lacuna.sources.staging import staged

COLUMN_KEYS = ["table_id", "file_basename", "col_idx", "column", "is_numeric"]


def with_mask(cells: DataFrame, is_missing: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Cells with ``missing``, computed once for all operators that follow; ``is_missing`` is a rule of (value, is_null) instead of the library's."""
    return with_missing(cells) if is_missing is None else cells.withColumn("missing", is_missing(F.col("value"), F.col("is_null")))


def column_profile(masked: DataFrame) -> DataFrame:
    """A row per column: counts, distinct present values, their mean length, and the share of aggregate cells.

    Two partial aggregations: cells to distinct values with counts, then values to columns. So a column
    of one frequent value is reduced before the shuffle, and no expansion of rows is needed for the distinct count.
    """
    value = F.when(F.col("missing"), None).otherwise(F.col("value"))
    nulls = F.count_if(F.col("is_null"))
    values = masked.groupBy(*COLUMN_KEYS, "missing", value.alias("v")).agg(F.count(F.lit(1)).alias("n"), nulls.alias("n_null"))
    n, present = F.col("n"), ~F.col("missing")
    aggregate = F.coalesce(F.col("v").rlike(AGGREGATE_CELL_PATTERN), F.lit(False))
    sums = values.groupBy(*COLUMN_KEYS).agg(
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(present, n)), F.lit(0)).alias("n_present"),
        F.coalesce(F.sum(F.when(~present, n - F.col("n_null"))), F.lit(0)).alias("n_disguised"),
        F.count_if(present).alias("n_unique_present"),
        F.coalesce(F.sum(F.when(present, n * F.length("v"))), F.lit(0)).alias("length"),
        F.coalesce(F.sum(F.when(present & aggregate, n)), F.lit(0)).alias("n_aggregate"),
    )

    def share(of: Column) -> Column:
        return F.when(F.col("n_present") > 0, of / F.col("n_present")).otherwise(0.0)

    return sums.select(
        *COLUMN_KEYS, "n_missing", "n_present", "n_disguised", "n_unique_present",
        share(F.col("n_unique_present")).alias("uniq_frac"), share(F.col("length")).alias("mean_present_len"), share(F.col("n_aggregate")).alias("agg_frac"),
    )


def rounded(profile: DataFrame) -> DataFrame:
    """The shares as the audit shows them: 4, 2 and 4 digits."""
    return profile.withColumns({"uniq_frac": F.round("uniq_frac", 4), "mean_present_len": F.round("mean_present_len", 2), "agg_frac": F.round("agg_frac", 4)})


def is_blocked(blocked: tuple[tuple[str, str], ...] = BLOCKED_COLUMNS) -> Column:
    """Whether (file, raw column name) is on the list of bad parses."""
    return F.struct("file_basename", "column").isin([F.struct(F.lit(f), F.lit(c)) for f, c in blocked]) if blocked else F.lit(False)


def eligibility(
    profile: DataFrame, min_n: int = 5, strict: bool = False, unique_id_max_frac: float = 0.95, free_text_max_mean_len: float = 60.0, aggregate_threshold: float = 0.10,
    blocked: tuple[tuple[str, str], ...] = BLOCKED_COLUMNS,
) -> DataFrame:
    """Add ``reason``: the first screen that a column fails, or null if it is eligible.

    ``strict`` adds the screens for unique ids, free text and aggregates, and leaves out the block list.
    """
    internal = F.col("column").rlike(INTERNAL_COLUMN_PATTERN_STRICT if strict else INTERNAL_COLUMN_PATTERN)
    reason = F.when(internal, "internal_column") if strict else F.when(is_blocked(blocked), "blocked_bad_parse").when(internal, "internal_column")
    reason = reason.when(F.col("n_missing") < min_n, "lt_n_missing").when(F.col("n_present") < min_n, "lt_n_present").when(F.col("n_unique_present") <= 1, "constant")
    if strict:
        reason = reason.when(F.col("uniq_frac") >= unique_id_max_frac, "unique_id").when(F.col("mean_present_len") > free_text_max_mean_len, "free_text")
        reason = reason.when(F.col("agg_frac") >= aggregate_threshold, "aggregate_column")
    return profile.withColumn("reason", reason)


def co_missing_classes(masked: DataFrame, signature: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(table_id, file_basename, leader_idx, n_missing, members): columns that miss exactly the same rows, each class of two or more once.

    ``members`` has (col_idx, column) in the order of the source, the first of them is the leader. Columns are brought together by a signature of their
    missing rows (count, xor and sum of hashes). Then each is checked exactly against its leader alone, as equality is transitive: every missing cell
    is matched once, however many columns a class has. Columns that share a signature, but not the leader's rows, are checked
    against a leader of their own in a further round. Only missing cells are read. ``masked`` should be a stored relation.
    """
    keys = ["table_id", "file_basename"]
    gone = masked.where("missing").select(*keys, "col_idx", "column", "row_idx")
    row = signature(F.col("row_idx"))
    signs = gone.groupBy(*keys, "col_idx", "column").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(20,0)")).alias("s"))
    open_, done = signs, None
    while True:
        alike = open_.groupBy(*keys, "n", "x", "s").agg(F.min("col_idx").alias("leader_idx"), F.count(F.lit(1)).alias("size")).where("size > 1")
        led = staged(open_.join(alike.drop("size"), [*keys, "n", "x", "s"]), "led")
        others = gone.select(*keys, "col_idx", "row_idx").join(led.where("col_idx <> leader_idx").select(*keys, "col_idx", "leader_idx"), [*keys, "col_idx"])
        leaders = gone.select(*keys, F.col("col_idx").alias("leader_idx"), "row_idx").join(led.select(*keys, "leader_idx").distinct(), [*keys, "leader_idx"])
        common = others.join(leaders, [*keys, "leader_idx", "row_idx"]).groupBy(*keys, "col_idx").agg(F.count(F.lit(1)).alias("common"))
        checked = staged(led.join(common, [*keys, "col_idx"], "left").withColumn("same", (F.col("col_idx") == F.col("leader_idx")) | F.coalesce(F.col("common") == F.col("n"), F.lit(False))), "checked")
        found = checked.where("same").groupBy(*keys, "leader_idx", F.col("n").alias("n_missing")).agg(F.array_sort(F.collect_list(F.struct("col_idx", "column"))).alias("members"))
        done = found if done is None else done.unionByName(found)
        open_ = checked.where("not same").select(*signs.columns)
        if open_.isEmpty():
            return done.where(F.size("members") > 1)


def co_missing_pairs(classes: DataFrame) -> DataFrame:
    """(table_id, file_basename, col_idx, column, other_idx, other) of classes: as many rows as pairs, for classes of few columns.

    Columns of equal names are not paired with each other.
    """
    keys = ["table_id", "file_basename"]
    one = classes.select(*keys, F.inline("members"), "members")
    pairs = one.select(*keys, "col_idx", "column", F.explode("members").alias("m"))
    return pairs.select(*keys, "col_idx", "column", F.col("m.col_idx").alias("other_idx"), F.col("m.column").alias("other")).where("column <> other")


def co_missing_lists(classes: DataFrame) -> DataFrame:
    """(table_id, file_basename, col_idx, co_missing_columns, n_co_missing): the names of a column's class but its own, as a JSON array in the order of the source."""
    rows = classes.select("table_id", "file_basename", F.inline("members"), "members")
    names = F.transform(F.filter("members", lambda m: m["column"] != F.col("column")), lambda m: m["column"])
    listed = rows.select("table_id", "file_basename", "col_idx", names.alias("names")).where(F.size("names") > 0)
    return listed.select("table_id", "file_basename", "col_idx", F.to_json("names").alias("co_missing_columns"), F.size("names").alias("n_co_missing"))


def co_missing_report(profile: DataFrame, lists: DataFrame) -> DataFrame:
    """A row per column that has co-missing ones: their names and number, and the number of the file's columns."""
    totals = profile.groupBy("file_basename").agg(F.count(F.lit(1)).alias("total_cols"))
    found = profile.join(lists, ["table_id", "file_basename", "col_idx"]).join(totals, "file_basename")
    return found.select(F.col("file_basename").alias("file"), F.col("column").alias("target_col"), column_type(F.col("column")).alias("column_type"), "co_missing_columns", "n_co_missing", "total_cols")
