"""Balanced, reproducible, append-only samples of missing and present cells.

Random order is the order of md5 over seed, run, table, column and row, so that the same sample is drawn in any
engine and at any partitioning. One column per table is plain window SQL. Several columns per table
must not share rows, which is a greedy choice within a table; it is a fold over arrays of candidates that
are first cut to the few rows that could be chosen at all, so a row of it is bounded by its table's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.missing import classify_cell
from lacuna.functions.text import column_type, is_priority, let
from lacuna.operators import ranking
from lacuna.operators.occurrences import last_entries
from lacuna.sources.staging import staged

TABLE = ["table_id", "file_basename"]


def validate(n: int, min_n: int | None, columns_per_table: int, max_per_file_column: int, max_per_column_type: int | None, seed: int) -> int:
    """Check the parameters and return the effective minimum per class."""
    low = n if min_n is None else min_n
    checks = {
        "seed must be a non-negative int": seed >= 0,
        "n must be >= 1": n >= 1,
        "columns_per_table must be >= 1": columns_per_table >= 1,
        "max_per_column_type must be >= 1 or None": max_per_column_type is None or max_per_column_type >= 1,
        "max_per_file_column must be >= 1": max_per_file_column >= 1,
        f"min_n ({low}) must be in [1, n={n}]": 1 <= low <= n,
    }
    for message, holds in checks.items():
        if not holds:
            raise ValueError(message)
    return low


def order_key(seed: int, run: Column, *parts: str) -> Column:
    """A key of uniform order: md5 of the seed, the table's run and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), run.cast("string"), *[F.col(p).cast("string") for p in parts]))


def column_order(eligible: DataFrame, seed: int, priority: str | None = None) -> DataFrame:
    """Add column_rank: each table's eligible columns in random order, priority columns first. Needs ``run_index``."""
    first = is_priority(F.col("column"), priority) if priority else F.lit(False)
    ordered = Window.partitionBy(*TABLE).orderBy(F.col("is_priority").desc(), order_key(seed, F.col("run_index"), "file_basename", "column"), "col_idx")
    return eligible.withColumn("is_priority", first).withColumn("column_rank", F.row_number().over(ordered))


def numbered(df: DataFrame, order: list[Column], first_id: int = 0, column: str = "sample_id") -> DataFrame:
    """Add a running number in the order of file_basename and then ``order``, which should name each row of a file.

    Rows are dealt by ranges of that order, so that a file of very many rows spreads over tasks like any other rows.
    """
    return ranking.numbered(df, [F.col("file_basename"), *order], name=column).withColumn(column, F.col(column) + (first_id - 1))


def prior_state(manifest: DataFrame, run_rule: str = "columns") -> dict[str, DataFrame]:
    """What an existing manifest excludes: used rows, drawn columns with their counts, runs by file, rows by label.

    A file's next run is numbered by the columns it has given (``run_rule="columns"``), or by its last run plus one ("last").
    """
    rules = {"columns": F.count_distinct("target_col"), "last": F.max("run_index") + 1}
    if run_rule not in rules:
        raise ValueError(f"run_rule must be one of {', '.join(rules)}")
    return {
        "rows": manifest.select("file_basename", "row_idx").distinct(),
        "columns": manifest.groupBy("file_basename", F.col("target_col").alias("column")).agg(F.count(F.lit(1)).alias("n_prior")),
        "runs": manifest.groupBy("file_basename").agg(rules[run_rule].cast("int").alias("run_index")),
        "labels": manifest.groupBy("column_type").agg(F.count(F.lit(1)).alias("n_label")),
    }


def next_sample_id(manifest: DataFrame) -> int:
    """The number after the manifest's largest, or 0."""
    last = manifest.agg(F.max("sample_id").alias("m")).first()["m"]
    return 0 if last is None else int(last) + 1


def reached(ranked: DataFrame, n: int, columns_per_table: int, max_per_file_column: int = 20) -> DataFrame:
    """The columns that a draw can come to, by their counts: those up to a table's ``columns_per_table``-th one that is sure to be drawn.

    A draw tries a table's columns in order until it has enough. A column is sure if ``n`` cells of each class are left whichever rows prior runs
    (``n_used``) and the run's other columns have taken, and its cap has room for them. ``n_missing`` and ``n_present`` must be counts of the cells that are drawn from.
    """
    left = F.least("n_missing", "n_present") - F.col("n_used")
    sure = (left >= n * (2 * columns_per_table - 1)) & (F.col("n_prior") + 2 * n <= max_per_file_column)
    before = Window.partitionBy(*TABLE).orderBy("column_rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("__sure", F.count_if(sure).over(before)).where(F.col("__sure") < columns_per_table).drop("__sure")


def candidates(
    masked: DataFrame, eligible: DataFrame, prior: dict[str, DataFrame] | None, seed: int, keep: int, skip_drawn: bool = True, priority: str | None = None, within: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Cells that could be drawn: the first ``keep`` unused cells of each eligible column and class, in random order.

    Adds run_index, n_prior, column_rank, order (rank within column and class), n_miss and n_pres. ``within`` may leave out ranked columns, whose cells are
    then not read further.
    """
    if prior:
        eligible = eligible.join(prior["columns"], ["file_basename", "column"], "left").join(prior["runs"], "file_basename", "left")
        eligible = eligible.join(prior["rows"].groupBy("file_basename").agg(F.count(F.lit(1)).alias("n_used")), "file_basename", "left")
        eligible = eligible.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_prior", "run_index", "n_used")})
        eligible = eligible.where("n_prior = 0") if skip_drawn else eligible
        masked = masked.join(prior["rows"], ["file_basename", "row_idx"], "left_anti")
    else:
        eligible = eligible.withColumns({"n_prior": F.lit(0), "run_index": F.lit(0), "n_used": F.lit(0)})
    ranked = column_order(eligible, seed, priority)
    ranked = (within(ranked) if within else ranked).select(*TABLE, "col_idx", "n_prior", "run_index", "column_rank")
    by = [*TABLE, "col_idx", "missing"]
    key = order_key(seed, F.col("run_index"), "file_basename", "column", "row_idx")
    cells = ranking.firsts(masked.join(ranked, [*TABLE, "col_idx"]), by, key, keep)
    cells = cells.withColumn("order", F.row_number().over(Window.partitionBy(*by).orderBy(key, "row_idx"))).where(F.col("order") <= keep)
    sizes = Window.partitionBy(*TABLE, "col_idx")
    return cells.withColumns({"n_miss": F.count_if(F.col("missing")).over(sizes), "n_pres": F.count_if(~F.col("missing")).over(sizes)})


def draw_one(found: DataFrame, n: int, min_n: int, max_per_file_column: int = 20) -> DataFrame:
    """The draw of one column per table: the first column in order with enough cells of both classes."""
    size = F.least(F.lit(n), F.col("n_miss"), F.col("n_pres"))
    able = found.withColumn("drawn", size).where((F.col("drawn") >= min_n) & (F.col("n_prior") + 2 * F.col("drawn") <= max_per_file_column))
    best = F.min("column_rank").over(Window.partitionBy(*TABLE))
    return able.withColumn("best", best).where("column_rank = best and order <= drawn").drop("best")


def draw_many(found: DataFrame, n: int, min_n: int, columns_per_table: int, max_per_file_column: int = 20) -> DataFrame:
    """The draw of several columns per table without sharing rows: greedy in column order, as a fold over each table's columns.

    ``found`` must keep ``n * (2 * columns_per_table - 1)`` cells of each class: a column's other picks can
    take away at most ``2 n`` for each column before it. So a fold holds so many row numbers of each class of each eligible column, and
    at most ``2 n`` used rows for each column drawn.
    """
    keys, found = [*TABLE, "col_idx"], staged(found, "found")  # read twice

    def rows(of: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("order", "row_idx")))), lambda x: x["row_idx"])

    columns = found.groupBy(*keys, "column_rank", "n_prior").agg(rows(F.col("missing")).alias("missing"), rows(~F.col("missing")).alias("present"))
    column = F.struct("column_rank", "col_idx", "n_prior", "missing", "present")
    tables = columns.groupBy(*TABLE).agg(F.array_sort(F.collect_list(column)).alias("columns"))
    nothing = F.from_json(F.lit('{"used": [], "picks": []}'), "used array<long>, picks array<struct<col_idx: int, drawn: int, missing: array<long>, present: array<long>>>")

    def take(state: Column, c: Column) -> Column:
        free = F.struct(F.array_except(c["missing"], state["used"]).alias("missing"), F.array_except(c["present"], state["used"]).alias("present"))

        def sized(rest: Column) -> Column:
            size = F.least(F.lit(n), F.size(rest["missing"]), F.size(rest["present"]))
            return F.struct(size.alias("size"), F.slice(rest["missing"], 1, size).alias("missing"), F.slice(rest["present"], 1, size).alias("present"))

        def added(pick: Column) -> Column:
            able = (pick["size"] >= min_n) & (c["n_prior"] + 2 * pick["size"] <= max_per_file_column) & (F.size(state["picks"]) < columns_per_table)
            one = F.struct(c["col_idx"].alias("col_idx"), pick["size"].alias("drawn"), pick["missing"].alias("missing"), pick["present"].alias("present"))
            return F.when(able, F.struct(F.concat(state["used"], pick["missing"], pick["present"]).alias("used"), F.concat(state["picks"], F.array(one)).alias("picks"))).otherwise(state)

        return let(free, lambda rest: let(sized(rest), added))

    picks = tables.select(*TABLE, F.inline(F.aggregate("columns", nothing, take)["picks"]))
    both = F.array(F.col("missing"), F.col("present"))
    chosen = picks.select(*keys, "drawn", F.explode(both).alias("rows")).select(*keys, "drawn", F.posexplode("rows").alias("order", "row_idx"))
    return found.drop("order").join(chosen.withColumn("order", F.col("order") + 1), [*keys, "row_idx"])


def draw(found: DataFrame, n: int, min_n: int, columns_per_table: int, max_per_file_column: int = 20) -> DataFrame:
    """The draw of as many columns per table as asked for."""
    return draw_one(found, n, min_n, max_per_file_column) if columns_per_table == 1 else draw_many(found, n, min_n, columns_per_table, max_per_file_column)


def within_label_cap(drawn: DataFrame, labels: DataFrame | None, max_per_column_type: int) -> DataFrame:
    """Drop drawn columns that would take a label over its cap, one by one in file and column order; prior rows count.

    A dropped column leaves the room to later, smaller ones. Once a column of some size does not fit, none of that size
    fits later. So what fits is among the first columns of each size, no more than fill the cap by themselves, and
    only these are brought together by label: their number is bounded by the cap.
    """
    columns = drawn.select(*TABLE, "col_idx", "column_type", "column_rank", (2 * F.col("drawn")).cast("long").alias("size")).distinct()
    columns = columns.join(labels, "column_type", "left") if labels is not None else columns.withColumn("n_label", F.lit(0))
    nth = F.row_number().over(Window.partitionBy("column_type", "size").orderBy("file_basename", "column_rank", "table_id"))
    columns = columns.withColumns({"nth": nth, "room": F.lit(max_per_column_type) - F.coalesce("n_label", F.lit(0))})
    first = columns.where(F.col("nth") <= max_per_column_type // 2).where(F.col("nth") * F.col("size") <= F.col("room"))
    column = F.struct("file_basename", "column_rank", "table_id", "col_idx", "size")
    by_label = first.groupBy("column_type").agg(F.min("room").alias("room"), F.array_sort(F.collect_list(column)).alias("columns"))
    none = F.struct(F.lit(0).cast("long").alias("total"), F.filter("columns", lambda _: F.lit(False)).alias("taken"))

    def take(state: Column, c: Column) -> Column:
        total = state["total"] + c["size"]
        return F.when(total <= F.col("room"), F.struct(total.alias("total"), F.concat(state["taken"], F.array(c)).alias("taken"))).otherwise(state)

    fits = by_label.select(F.explode(F.aggregate("columns", none, take)["taken"]).alias("c")).select("c.table_id", "c.file_basename", "c.col_idx")
    return drawn.join(fits, [*TABLE, "col_idx"], "left_semi")


def label_capped(found: DataFrame, new: DataFrame, *, n: int, min_n: int | None = None, columns_per_table: int = 1, max_per_file_column: int = 20) -> DataFrame:
    """(file_basename, col_idx): the columns that a run's candidates give without a label's cap and its new rows do not have."""
    drawn = draw(found, n, n if min_n is None else min_n, columns_per_table, max_per_file_column).select("file_basename", "col_idx").distinct()
    return drawn.join(new.select("file_basename", F.col("target_col_idx").alias("col_idx")), ["file_basename", "col_idx"], "left_anti")


def build_manifest(
    masked: DataFrame, eligible: DataFrame, lists: DataFrame | None = None, manifest: DataFrame | None = None, *, n: int = 5, min_n: int | None = None, columns_per_table: int = 1,
    skip_drawn: bool = True, priority: str | None = None, max_per_file_column: int = 20, max_per_column_type: int | None = None, seed: int = 42, first_id: int = 0, label_mode: str = "label", occurrences: DataFrame | None = None,
    run_rule: str = "columns",
) -> DataFrame:
    """New manifest rows: one run over masked cells and eligible columns, on top of an existing manifest.

    Eligible columns and drawn cells are staged: the first are then of known size, so that the planner decides whether to
    broadcast them to the cells, and the second are read twice. ``masked`` should be a stored relation too, the one that ``eligible`` was counted
    on: columns behind those that are sure to be drawn are left out by their counts (``reached``), so that most cells are not hashed.
    ``label_mode="raw"`` takes the raw cell as the token, or its value in a list of ``occurrences`` where it is in one.
    """
    low = validate(n, min_n, columns_per_table, max_per_file_column, max_per_column_type, seed)
    prior = prior_state(manifest, run_rule) if manifest is not None else None
    found = candidates(masked, staged(eligible, "eligible"), prior, seed, n * (2 * columns_per_table - 1), skip_drawn, priority, lambda ranked: reached(ranked, n, columns_per_table, max_per_file_column))
    drawn = draw(found, n, low, columns_per_table, max_per_file_column)
    drawn = drawn.withColumn("column_type", column_type(F.col("column")))
    if max_per_column_type is not None:
        drawn = within_label_cap(drawn, prior["labels"] if prior else None, max_per_column_type)
    drawn = staged(drawn, "drawn")
    position = 2 * (F.col("order") - 1) + F.when(F.col("missing"), 0).otherwise(1)
    cell = classify_cell(F.col("value"), F.col("is_numeric"), F.col("is_null"), label_mode=label_mode)
    out = numbered(drawn, [F.col("column_rank"), position], first_id).withColumn("cell", cell)
    token = F.col("cell.special_token")
    if occurrences is not None:
        out = out.join(last_entries(occurrences), ["file_basename", "column", "row_idx"], "left")
        token = F.when(F.col("cell.missing_kind") == "disguised", F.coalesce("occurrence", token))
    out = out.join(lists.select("table_id", "col_idx", "co_missing_columns"), ["table_id", "col_idx"], "left") if lists is not None else out.withColumn("co_missing_columns", F.lit(None).cast("string"))
    return out.select(
        "sample_id", F.concat(F.lit("datasets/"), "file_basename").alias("file"), "file_basename", "table_id", "column_type", F.col("column").alias("target_col"), F.col("col_idx").alias("target_col_idx"),
        "row_idx", F.col("missing").cast("int").alias("y"), F.col("missing").alias("is_missing"), F.col("cell.missing_kind").alias("missing_kind"), token.alias("special_token"),
        F.col("cell.original_value").alias("original_value"), F.coalesce("co_missing_columns", F.lit("[]")).alias("co_missing_columns"), F.lit(seed).alias("random_state"), "run_index",
    )


def append(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The old rows and the new ones; columns that only one side has are null on the other."""
    return manifest.unionByName(new, allowMissingColumns=True)


def audit(eligibility: DataFrame, new: DataFrame, found: DataFrame | None = None, *, n: int = 5, min_n: int | None = None, columns_per_table: int = 1, max_per_file_column: int = 20, label_capped: DataFrame | None = None) -> DataFrame:
    """A summary row per scanned column: profile, whether it was drawn, and the reason if it was not.

    With the run's candidates as ``found``, columns that were tried without success get their own reasons: a table's
    columns are tried in order until enough are drawn. ``label_capped`` names columns that were drawn and that a label's cap
    has dropped.
    """
    keys = ["file_basename", "col_idx"]
    drawn = new.groupBy("file_basename", F.col("target_col_idx").alias("col_idx")).agg(F.count_if(F.col("is_missing")).alias("n_sampled_missing"), F.count_if(~F.col("is_missing")).alias("n_sampled_present"))
    out = eligibility.join(drawn, keys, "left")
    tried, settled = F.lit(None).cast("string"), F.col("n_sampled_missing").isNotNull()
    if label_capped is not None:
        out = out.join(label_capped.select(*keys).distinct().withColumn("by_label", F.lit("max_per_column_type_reached")), keys, "left")
        settled = settled | F.col("by_label").isNotNull()
    if found is not None:
        low = n if min_n is None else min_n
        size = F.least(F.lit(n), F.col("n_miss"), F.col("n_pres"))
        capped = (size >= low) & (F.col("n_prior") + 2 * size > max_per_file_column)
        ranks = found.groupBy(*keys, "column_rank").agg(F.max(capped).alias("capped"))
        out = out.join(ranks, keys, "left")
        file = Window.partitionBy("file_basename")
        last = F.max(F.when(settled, F.col("column_rank"))).over(file)
        enough = F.count_if(settled).over(file) >= columns_per_table
        out = out.withColumn("visited", ~enough | F.coalesce(F.col("column_rank") < last, F.col("column_rank").isNull()))
        tried = F.when(F.col("visited"), F.when(F.coalesce("capped", F.lit(False)), "max_per_file_column_reached").otherwise("insufficient_rows_after_exclusion"))
    if label_capped is not None:
        tried = F.coalesce(F.col("by_label"), tried)
    reason = F.when(F.col("n_sampled_missing").isNotNull(), None).when(F.col("reason").isNotNull(), F.col("reason")).otherwise(F.coalesce(tried, F.lit("not_selected_this_run")))
    return out.select(
        F.col("file_basename").alias("file"), F.col("column").alias("target_col"), column_type(F.col("column")).alias("column_type"), (F.col("n_missing") + F.col("n_present")).alias("n_rows_total"),
        F.col("n_missing").alias("n_missing_total"), F.col("n_present").alias("n_present_total"), F.col("n_disguised").alias("n_disguised_total"),
        F.round("uniq_frac", 4).alias("uniq_frac"), F.round("mean_present_len", 2).alias("mean_present_len"), F.round("agg_frac", 4).alias("aggregate_frac"),
        F.col("n_sampled_missing").isNotNull().alias("sampled"), F.coalesce("n_sampled_missing", F.lit(0)).alias("n_sampled_missing"), F.coalesce("n_sampled_present", F.lit(0)).alias("n_sampled_present"),
        reason.alias("skip_reason"),
    )


def balance_violations(manifest: DataFrame, n: int, min_n: int) -> DataFrame:
    """Drawn columns whose classes are unequal or outside [min_n, n]."""
    sums = manifest.groupBy("file", "target_col").agg(F.count_if(F.col("is_missing")).alias("n_missing"), F.count_if(~F.col("is_missing")).alias("n_present"))
    return sums.where((F.col("n_missing") != F.col("n_present")) | ~F.col("n_missing").between(min_n, n))


def _kept(manifest: DataFrame, keys: list[str], cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each group, as even between the classes as there are rows."""
    group = Window.partitionBy(*keys)
    missing = F.count_if(F.col("is_missing")).over(group)
    total = F.count(F.lit(1)).over(group)
    by_class = Window.partitionBy(*keys, "is_missing").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"))), "sample_id")
    rows = manifest.withColumns({"__missing": missing, "__present": total - missing, "__rank": F.row_number().over(by_class)})
    want = F.least(F.col("__missing"), F.lit((cap + 1) // 2))
    quota_present = F.least(F.col("__present"), F.lit(cap) - want)
    quota_missing = F.least(F.col("__missing"), F.lit(cap) - quota_present)
    kept = rows.where((F.col("__missing") + F.col("__present") <= cap) | (F.col("__rank") <= F.when(F.col("is_missing"), quota_missing).otherwise(quota_present)))
    return kept.drop("__missing", "__present", "__rank")


def cap_maxima(manifest: DataFrame) -> DataFrame:
    """(level, n_max): the most rows that a file's column and a label have; an empty manifest has 0."""
    by_column = manifest.groupBy("file_basename", "target_col").count().select(F.lit("file_column").alias("level"), "count")
    by_label = manifest.groupBy("column_type").count().select(F.lit("column_type").alias("level"), "count")
    levels = manifest.sparkSession.createDataFrame([("file_column",), ("column_type",)], "level string")
    return levels.join(by_column.unionByName(by_label), "level", "left").groupBy("level").agg(F.coalesce(F.max("count"), F.lit(0)).alias("n_max"))


def check_caps(manifest: DataFrame, max_per_file_column: int = 20, max_per_column_type: int | None = None) -> None:
    """Raise ValueError if a manifest is beyond a cap."""
    most = {r["level"]: r["n_max"] for r in cap_maxima(manifest).collect()}
    for level, cap in (("file_column", max_per_file_column), ("column_type", max_per_column_type)):
        if cap is not None and most[level] > cap:
            raise ValueError(f"a {level} has {most[level]} rows, its cap is {cap}")


def prune_to_caps(manifest: DataFrame, max_per_file_column: int = 20, max_per_column_type: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of a manifest within the caps, first by file and column, then by label; no row is added."""
    out = _kept(manifest, ["file_basename", "target_col"], max_per_file_column, seed)
    return out if max_per_column_type is None else _kept(out, ["column_type"], max_per_column_type, seed)
