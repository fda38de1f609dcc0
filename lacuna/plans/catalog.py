"""Registered queries over the fixture tables, with their DuckDB equivalents.

Column names and values agree on both sides; shares are rounded to six digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import lexicon as lx
from lacuna.functions import missing as ms
from lacuna.functions import text as tx
from lacuna.operators import occurrences, prep, profile, sampling, tokens, vectors
from lacuna.plans import embed, fixtures, ledger, oracle, runner
from lacuna.sources import corpus, staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The whole relation, without the file name, which the table's name implies.
KEYS = ["table_id", "row_idx", "column"]
_K = 'table_id, row_idx, "column"'


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


# ------------------------------------------------------------------------------- cells and text


@query("is_missing_mask", oracle.with_cells(f"SELECT {_K}, missing FROM masked"))
def is_missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.masked(spark, sf_dir).select(*KEYS, "missing")


@query("classify_cells", oracle.with_cells(f"SELECT {_K}, missing_kind, special_token, original_value FROM cell"))
def classify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ms.classify_cell(F.col("value"), F.col("is_numeric"), F.col("is_null"))
    return fixtures.cells(spark, sf_dir).select(*KEYS, found.alias("c")).select(*KEYS, "c.*")


_OCCURRENCES = f"""SELECT table_id, file_basename AS file, "column", row_idx, value AS original_value, lower({oracle.stripped("value")}) AS normalized_value, label AS matched_pattern, kind FROM classified WHERE kind IS NOT NULL"""


@query("occurrence_scan", oracle.with_cells(_OCCURRENCES))
def occurrence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.occurrences(fixtures.cells(spark, sf_dir))


@query(
    "occurrence_summary",
    oracle.with_cells(f"""SELECT normalized_value, kind, matched_pattern, count(*) AS n_occurrences, count(DISTINCT "column") AS n_columns, count(DISTINCT file) AS n_files FROM ({_OCCURRENCES}) GROUP BY ALL"""),
)
def occurrence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.occurrence_summary(tokens.occurrences(fixtures.cells(spark, sf_dir)))


_TEXTS = """
SELECT DISTINCT t FROM (
  SELECT concat(p_name, '_', p_type) AS t FROM {part} UNION ALL SELECT concat(p_brand, '|', p_type) FROM {part} UNION ALL SELECT o_orderpriority FROM {orders}
  UNION ALL SELECT concat('avg', c_name, 'ID-', c_mktsegment) FROM {customer} UNION ALL SELECT concat(event_type, 'URLName ', props) FROM {events}
)
"""


@query("normalize_text", f"SELECT t, {oracle.normalized('t')} AS normal FROM ({_TEXTS.format(part='part', orders='orders', customer='customer', events='events')})")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.sql(_TEXTS, **{t: fixtures.load(spark, sf_dir, t) for t in ("part", "orders", "customer", "events")})
    return texts.select("t", tx.normalize(F.col("t")).alias("normal"))


HEADERS = (
    "customerID", "avg_bp", "URLName", "U.S. state", "Unnamed: 0", "__index_level_0__", "age 2", "total.case", "Gender_2", "location-3", "MG", "RNA levels", "TAPEWORM", "ELISAassay", "sbp|dbp", " padded ",
    "cityName", "collection date (1)", "growth rate 2011-2016", "n", "Country", "maxTemp", "HIPAA id", "regionOf", "dateTime", "sexRatio",
)
_ALONE = " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HEADERS))
_JOINED = " ".join(f"WHEN {k} THEN concat('{h}', s, p_name)" for k, h in enumerate(HEADERS))
#: A header of each part: one of ``HEADERS``, alone or before the part's name in one of several spellings.
_HEADERS = f"""
SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 = 0 THEN CASE p_partkey % 26 {_ALONE} END ELSE CASE p_partkey % 26 {_JOINED} END END AS t
FROM (SELECT *, CASE p_partkey % 5 WHEN 1 THEN '_' WHEN 2 THEN '' WHEN 3 THEN ' - ' ELSE '.' END AS s FROM {{part}})
"""
_HEADERS_SQL = f"({_HEADERS.format(part='part')})"


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HEADERS, part=fixtures.load(spark, sf_dir, "part"))


@query("normalize_headers", f"SELECT p_partkey, t, {oracle.normalized('t')} AS normal FROM {_HEADERS_SQL}")
def normalize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("p_partkey", "t", tx.normalize(F.col("t")).alias("normal"))


@query("column_type_rename", f"SELECT p_partkey, t, {oracle.column_type('t')} AS column_type FROM {_HEADERS_SQL}")
def column_type_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("p_partkey", "t", tx.column_type(F.col("t")).alias("column_type"))


_RANKED = f"row_number() OVER (PARTITION BY p_brand ORDER BY {oracle.priority('t')} DESC, md5('42|0|' || p_brand || '.parquet|' || t))"


@query("priority_order", f"SELECT p_brand AS table_id, t, {oracle.priority('t')} AS is_priority, {_RANKED} AS column_rank FROM (SELECT DISTINCT p_brand, t FROM {_HEADERS_SQL})")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' headers as the columns of one table for each brand, in the order in which a draw tries them."""
    columns = _headers(spark, sf_dir).select(F.col("p_brand").alias("table_id"), "t").distinct()
    ranked = sampling.column_order(columns.withColumns({"file_basename": F.concat("table_id", F.lit(".parquet")), "col_idx": F.lit(0), "run_index": F.lit(0), "column": F.col("t")}), 42, lx.PRIORITY_PATTERN)
    return ranked.select("table_id", "t", "is_priority", F.col("column_rank").cast("long").alias("column_rank"))


@query("safe_names", f"SELECT p_partkey, t, regexp_replace(t, '[^A-Za-z0-9_]+', '_', 'g') AS safe FROM {_HEADERS_SQL}")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir).select("p_partkey", "t", tx.safe_name(F.col("t")).alias("safe"))


#: A number of each order: its key's last digits at one of 41 powers of ten.
_NUMBERS = "SELECT o_orderkey, CAST(concat(CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE '' END, CAST(o_orderkey % 997 AS STRING), CASE WHEN o_custkey % 2 = 0 THEN '.5' ELSE '' END, 'e', CAST(o_orderkey % 41 - 20 AS STRING)) AS DOUBLE) AS number FROM {orders}"


@query("number_text", f"SELECT o_orderkey, number, CAST(number AS VARCHAR) AS shown FROM ({_NUMBERS.format(orders='orders')})")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats of many sizes as both readers of a corpus show them."""
    return spark.sql(_NUMBERS, orders=fixtures.load(spark, sf_dir, "orders")).select("o_orderkey", "number", corpus.float_text(F.col("number")).alias("shown"))


@query(
    "format_cell",
    f"""WITH cells AS ({oracle.cells_sql(("orders_dirty",))}) SELECT row_idx, "column",
      CASE WHEN is_null THEN '' WHEN is_numeric AND CAST(value AS DOUBLE) = floor(CAST(value AS DOUBLE)) THEN CAST(CAST(value AS DOUBLE)::BIGINT AS VARCHAR) ELSE value END AS shown FROM cells""".replace(
        "CAST(value AS DOUBLE)", "TRY_CAST(value AS DOUBLE)"
    ),
)
def format_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("is_numeric"), F.col("value").try_cast("double"))
    return fixtures.cells(spark, sf_dir, ("orders_dirty",)).select("row_idx", "column", ms.format_cell(F.col("value"), number, F.col("is_null")).alias("shown"))


@query("canonicalize_missing", oracle.with_cells(f"""SELECT {_K}, CASE WHEN missing AND "column" <> 'status' THEN 'n/a' ELSE value END AS value FROM masked"""))
def canonicalize_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.canonicalize_missing(fixtures.cells(spark, sf_dir), skip_columns=("status",)).select(*KEYS, "value")


# ------------------------------------------------------------------------------- profiles

_PROFILE = """table_id, "column", n_missing, n_present, n_disguised, n_unique_present, round(uniq_frac, 6) AS uniq_frac, round(mean_present_len, 6) AS mean_present_len, round(agg_frac, 6) AS agg_frac"""


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "table_id", "column", "n_missing", "n_present", "n_disguised", "n_unique_present", F.round("uniq_frac", 6).alias("uniq_frac"),
        F.round("mean_present_len", 6).alias("mean_present_len"), F.round("agg_frac", 6).alias("agg_frac"), *more,
    )


@query("column_profile", oracle.with_cells(f"SELECT {_PROFILE} FROM profile"))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(profile.column_profile(fixtures.masked(spark, sf_dir)))


@query("eligibility_reasons", oracle.with_cells(f"SELECT {_PROFILE}, reason FROM eligible"))
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(profile.eligibility(profile.column_profile(fixtures.masked(spark, sf_dir))), "reason")


@query("eligibility_strict", oracle.with_cells(f"SELECT {_PROFILE}, reason FROM strict", {"strict": oracle.eligible(strict=True)}))
def eligibility_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(profile.eligibility(profile.column_profile(fixtures.masked(spark, sf_dir)), strict=True), "reason")


BLOCKED = (*lx.BLOCKED_COLUMNS, ("orders_dirty.parquet", "note"), ("doc_labels.parquet", "toxic"))


@query("blocked_columns", oracle.with_cells(f"SELECT {_PROFILE}, reason FROM blocked", {"blocked": oracle.eligible(blocked=BLOCKED)}))
def blocked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(profile.eligibility(profile.column_profile(fixtures.masked(spark, sf_dir)), blocked=BLOCKED), "reason")


@query("co_missing_pairs", oracle.with_cells('SELECT table_id, "column", other FROM pairs'))
def co_missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.co_missing_pairs(profile.co_missing_classes(_masked(spark, sf_dir))).select("table_id", "column", "other")


_CLASSES = """
SELECT table_id, leader_idx, n_missing, class_size, m.c AS col_idx, m.n AS "column" FROM (
  SELECT table_id, min(col_idx) AS leader_idx, len(r) AS n_missing, count(*) AS class_size, unnest(list({'c': col_idx, 'n': "column"})) AS m
  FROM (SELECT table_id, file_basename, col_idx, "column", list(row_idx ORDER BY row_idx) AS r FROM masked WHERE missing GROUP BY ALL) GROUP BY table_id, file_basename, r HAVING count(*) > 1
)
"""


@query("co_missing_classes", oracle.with_cells(_CLASSES))
def co_missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with their members, a row for each member, over all columns of both tables."""
    found = profile.co_missing_classes(_masked(spark, sf_dir))
    return found.select("table_id", "leader_idx", "n_missing", F.size("members").cast("long").alias("class_size"), F.inline("members"))


_REPORT = f"""
SELECT e.file_basename AS file, e."column" AS target_col, {oracle.column_type('e."column"')} AS column_type, l.co_missing_columns, n.n_co_missing, t.total_cols
FROM eligible e JOIN lists l ON e.table_id = l.table_id AND e.col_idx = l.col_idx
JOIN (SELECT table_id, col_idx, count(*)::INT AS n_co_missing FROM pairs GROUP BY ALL) n ON e.table_id = n.table_id AND e.col_idx = n.col_idx
JOIN (SELECT file_basename, count(*) AS total_cols FROM eligible GROUP BY ALL) t ON e.file_basename = t.file_basename
"""


@query("co_missing_report", oracle.with_cells(_REPORT))
def co_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir)
    return profile.co_missing_report(profile.column_profile(masked), profile.co_missing_lists(profile.co_missing_classes(masked)))


# ------------------------------------------------------------------------------- sampling


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked cells, staged: profiles, co-missing columns and draws all read them."""
    return staging.staged(fixtures.masked(spark, sf_dir), "masked")


def _prepared(masked: DataFrame, min_profile: int = 5) -> tuple[DataFrame, DataFrame]:
    """Eligible columns and co-missing lists, staged, as all runs over the same cells share them."""
    eligible = profile.eligibility(profile.column_profile(masked), min_n=min_profile).where("reason is null")
    return staging.staged(eligible, "eligible"), staging.staged(profile.co_missing_lists(profile.co_missing_classes(masked)), "co-missing")


def _manifest(spark: SparkSession, sf_dir: str, manifest: DataFrame | None = None, masked: DataFrame | None = None, prepared: tuple[DataFrame, DataFrame] | None = None, **options) -> DataFrame:
    masked = _masked(spark, sf_dir) if masked is None else masked
    eligible, lists = prepared or _prepared(masked)
    return sampling.build_manifest(masked, eligible, lists, manifest, **options)


@query("balanced_draw", oracle.with_cells(oracle.manifest(), oracle.draw(5, 5)))
def balanced_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


@query("balanced_draw_priority", oracle.with_cells(oracle.manifest(seed=7), oracle.draw(3, 3, seed=7, use_priority=True)))
def balanced_draw_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir, n=3, seed=7, priority=lx.PRIORITY_PATTERN)


@query("soft_min_draw", oracle.with_cells(oracle.manifest(), oracle.draw(400, 5, cap=800)))
def soft_min_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir, n=400, min_n=5, max_per_file_column=800)


#: A second run on top of the first: used rows and drawn columns are excluded, and numbers go on.
_SECOND = oracle.draw(
    5, 5, run="1", used="WHERE NOT EXISTS (SELECT 1 FROM first_run f WHERE f.file_basename = c.file_basename AND f.row_idx = c.row_idx)",
    skip='AND NOT EXISTS (SELECT 1 FROM first_run f WHERE f.file_basename = eligible.file_basename AND f.target_col = eligible."column")',
)


def _renamed(ctes: dict[str, str], prefix: str) -> dict[str, str]:
    """The same expressions under names with a prefix."""
    out = {}
    for name, body in ctes.items():
        for other in ctes:
            body = body.replace(f"FROM {other} ", f"FROM {prefix}{other} ").replace(f"FROM {other}\n", f"FROM {prefix}{other}\n").replace(f"JOIN {other} ", f"JOIN {prefix}{other} ")
            if body.endswith(f"FROM {other}"):
                body += f"\x00{prefix}"
                body = body.replace(f"FROM {other}\x00{prefix}", f"FROM {prefix}{other}")
        out[prefix + name] = body
    return out


_TWO_RUNS = _renamed(oracle.draw(5, 5), "a_") | {"first_run": oracle.manifest(source="a_drawn")} | _SECOND
_SECOND_ROWS = oracle.manifest(first_id=0)


@query("append_draw", oracle.with_cells(f"SELECT * FROM first_run UNION ALL BY NAME SELECT * REPLACE (sample_id + (SELECT count(*) FROM first_run) AS sample_id) FROM ({_SECOND_ROWS})", _TWO_RUNS))
def append_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir)
    prepared = _prepared(masked)
    first = staging.staged(_manifest(spark, sf_dir, masked=masked, prepared=prepared), "manifest")  # as in use: the second run reads a stored table
    return sampling.append(first, _manifest(spark, sf_dir, first, masked, prepared, first_id=sampling.next_sample_id(first)))


@query("column_skip", oracle.with_cells(f"SELECT target_col, file_basename, count(*) AS n FROM ({_SECOND_ROWS}) GROUP BY ALL", _TWO_RUNS))
def column_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir)
    prepared = _prepared(masked)
    second = _manifest(spark, sf_dir, staging.staged(_manifest(spark, sf_dir, masked=masked, prepared=prepared), "manifest"), masked, prepared)
    return second.groupBy("target_col", "file_basename").agg(F.count(F.lit(1)).alias("n"))


@query("caps_filter", oracle.with_cells(oracle.manifest(), oracle.draw(400, 2, cap=700)))
def caps_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir, n=400, min_n=2, max_per_file_column=700)


_MAXIMA = """
SELECT 'file_column' AS level, coalesce(max(n), 0) AS n_max FROM (SELECT count(*) AS n FROM manifest GROUP BY file_basename, target_col)
UNION ALL SELECT 'column_type', coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM manifest GROUP BY column_type)
"""


@query("cap_maxima", oracle.with_cells(_MAXIMA, oracle.draw(400, 5, cap=800) | {"manifest": oracle.manifest()}))
def cap_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_maxima(staging.staged(_manifest(spark, sf_dir, n=400, min_n=5, max_per_file_column=800), "manifest"))


_FIRST_GROUPS = "SELECT sample_id, table_id, target_col FROM manifest WHERE (table_id, target_col_idx) IN (SELECT DISTINCT table_id, target_col_idx FROM manifest ORDER BY ALL LIMIT 1)"


@query("first_groups", oracle.with_cells(_FIRST_GROUPS, oracle.draw(5, 5) | {"manifest": oracle.manifest()}))
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first group, as a run that is only tried takes it."""
    return runner.first_groups(staging.staged(_manifest(spark, sf_dir), "manifest"), 1).select("sample_id", "table_id", "target_col")


_PRUNED = """
WITH m AS (SELECT doc_id AS sample_id, source AS file_basename, lang AS target_col, lang AS column_type, doc_id % 3 = 0 AS is_missing FROM documents),
a AS (SELECT *, count(*) FILTER (is_missing) OVER g AS mi, count(*) FILTER (NOT is_missing) OVER g AS pr, row_number() OVER (PARTITION BY file_basename, target_col, is_missing ORDER BY md5('42|' || sample_id), sample_id) AS rn FROM m WINDOW g AS (PARTITION BY file_basename, target_col)),
b AS (SELECT sample_id, file_basename, target_col, column_type, is_missing FROM a WHERE mi + pr <= 10 OR rn <= CASE WHEN is_missing THEN least(mi, 10 - least(pr, 10 - least(mi, 5))) ELSE least(pr, 10 - least(mi, 5)) END),
c AS (SELECT *, count(*) FILTER (is_missing) OVER g AS mi, count(*) FILTER (NOT is_missing) OVER g AS pr, row_number() OVER (PARTITION BY column_type, is_missing ORDER BY md5('42|' || sample_id), sample_id) AS rn FROM b WINDOW g AS (PARTITION BY column_type))
SELECT sample_id, file_basename, target_col, column_type, is_missing FROM c WHERE mi + pr <= 75 OR rn <= CASE WHEN is_missing THEN least(mi, 75 - least(pr, 75 - least(mi, 38))) ELSE least(pr, 75 - least(mi, 38)) END
"""


@query("prune_to_caps", _PRUNED)
def prune_to_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.load(spark, sf_dir, "documents")
    manifest = docs.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("file_basename"), F.col("lang").alias("target_col"), F.col("lang").alias("column_type"), (F.col("doc_id") % 3 == 0).alias("is_missing"))
    return sampling.prune_to_caps(manifest, 10, 75, 42)


_SUMS = "SELECT file, target_col, count(*) FILTER (is_missing) AS n_missing, count(*) FILTER (NOT is_missing) AS n_present FROM token GROUP BY ALL"

_TOKEN = f"""
SELECT (row_number() OVER (ORDER BY t.file_basename, t.col_idx, wanted DESC, rank) - 1)::BIGINT AS sample_id, 'datasets/' || t.file_basename AS file, t.file_basename, t.table_id, {oracle.column_type('"column"')} AS column_type, "column" AS target_col,
  t.col_idx AS target_col_idx, row_idx, wanted::INT AS y, wanted AS is_missing, CASE WHEN wanted THEN 'disguised' ELSE 'present' END AS missing_kind, CASE WHEN wanted THEN special_token END AS special_token, value AS original_value,
  coalesce(l.co_missing_columns, '[]') AS co_missing_columns, 42 AS random_state
FROM (
  SELECT *, row_number() OVER (PARTITION BY table_id, col_idx, wanted ORDER BY CASE WHEN wanted THEN row_idx END, CASE WHEN NOT wanted THEN md5('42|0|' || file_basename || '|' || "column" || '|' || row_idx) END, row_idx) AS rank
  FROM (
    SELECT *, count(*) FILTER (wanted) OVER (PARTITION BY table_id, col_idx) AS n_wanted FROM (
      SELECT *, coalesce(missing AND missing_kind = 'disguised' AND (lower(special_token) LIKE 'unknown%' OR lower(special_token) IN ({oracle.strings(lx.NOT_APPLICABLE_LABELS)})), false) AS wanted FROM cell)
    WHERE wanted OR NOT missing)
) t LEFT JOIN lists l ON t.table_id = l.table_id AND t.col_idx = l.col_idx
WHERE n_wanted > 0 AND (wanted OR rank <= n_wanted)
"""


def _token_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir)
    return tokens.token_manifest(masked, profile.co_missing_lists(profile.co_missing_classes(masked)))


@query("token_manifest", oracle.with_cells(_TOKEN))
def token_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_manifest(spark, sf_dir)


@query(
    "token_group_counts",
    oracle.with_cells(f"SELECT CASE WHEN lower(special_token) LIKE 'unknown%' THEN 'unknown' ELSE 'not applicable' END AS token_group, count(*) AS n FROM token WHERE y = 1 GROUP BY 1", {"token": _TOKEN}),
)
def token_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_group_counts(_token_manifest(spark, sf_dir))


@query("balance_invariant", oracle.with_cells(f"SELECT * FROM ({_SUMS}) WHERE n_missing <> n_present OR n_missing NOT BETWEEN 1 AND 300", {"token": _TOKEN}))
def balance_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance_violations(_token_manifest(spark, sf_dir), 300, 1)


_AUDIT = f"""
SELECT e.file_basename AS file, e."column" AS target_col, {oracle.column_type('e."column"')} AS column_type, n_missing + n_present AS n_rows_total, n_missing AS n_missing_total, n_present AS n_present_total, n_disguised AS n_disguised_total,
  round(uniq_frac, 4) AS uniq_frac, round(mean_present_len, 2) AS mean_present_len, round(agg_frac, 4) AS aggregate_frac, d.n IS NOT NULL AS sampled, coalesce(d.n, 0) AS n_sampled_missing, coalesce(d.p, 0) AS n_sampled_present,
  CASE WHEN d.n IS NOT NULL THEN NULL WHEN reason IS NOT NULL THEN reason ELSE 'not_selected_this_run' END AS skip_reason
FROM eligible e LEFT JOIN (SELECT file_basename, col_idx, count(*) FILTER (missing) AS n, count(*) FILTER (NOT missing) AS p FROM drawn GROUP BY ALL) d ON e.file_basename = d.file_basename AND e.col_idx = d.col_idx
"""


@query("sample_summary", oracle.with_cells(_AUDIT, oracle.draw(5, 5)))
def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir)
    found = profile.eligibility(profile.column_profile(masked))
    return sampling.audit(found, sampling.build_manifest(masked, found.where("reason is null")))


@query("multi_column_draw", oracle.with_cells(oracle.manifest(), oracle.draw_many(5, 5, 4), recursive=True))
def multi_column_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir, columns_per_table=4)


#: The orders as six files, whose columns share their labels.
_SIX_FILES = f"""SELECT * REPLACE ('orders_' || (row_idx % 6) AS table_id, 'orders_' || (row_idx % 6) || '.parquet' AS file_basename) FROM ({fixtures.cells_sql(("orders_dirty",))})"""
_LABEL_CAP = 350
_CAPPED = {"uncapped" if k == "drawn" else k: v for k, v in oracle.draw_many(100, 5, 3, cap=200).items()} | {
    "all_drawn": """SELECT *, count(*) FILTER (missing) OVER (PARTITION BY table_id, col_idx) AS n_drawn FROM uncapped""",
    "label_columns": f"""SELECT *, row_number() OVER (PARTITION BY column_type ORDER BY file_basename, column_rank) AS k FROM (SELECT DISTINCT table_id, file_basename, col_idx, column_rank, 2 * n_drawn AS size, {oracle.column_type('"column"')} AS column_type FROM all_drawn)""",
    "fitting": f"""SELECT DISTINCT column_type, 0::BIGINT AS k, 0::BIGINT AS total, NULL::VARCHAR AS table_id, NULL::INTEGER AS col_idx FROM label_columns
      UNION ALL SELECT c.column_type, c.k, CASE WHEN g.total + c.size <= {_LABEL_CAP} THEN g.total + c.size ELSE g.total END, CASE WHEN g.total + c.size <= {_LABEL_CAP} THEN c.table_id END, c.col_idx
      FROM fitting g JOIN label_columns c ON c.column_type = g.column_type AND c.k = g.k + 1""",
    "drawn": "SELECT d.* FROM all_drawn d JOIN fitting f ON f.table_id = d.table_id AND f.col_idx = d.col_idx",
}


@query("label_capped_draw", oracle.with_cells(oracle.manifest(), {"cells": _SIX_FILES} | _CAPPED, recursive=True))
def label_capped_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of each of six files, of which a label's columns are taken one by one as long as they stay within its cap."""
    table = F.concat(F.lit("orders_"), (F.col("row_idx") % 6).cast("string"))
    files = fixtures.masked(spark, sf_dir, ("orders_dirty",)).withColumns({"table_id": table, "file_basename": F.concat(table, F.lit(".parquet"))})
    return _manifest(spark, sf_dir, masked=staging.staged(files, "masked"), n=100, min_n=5, columns_per_table=3, max_per_file_column=200, max_per_column_type=_LABEL_CAP)


# ------------------------------------------------------------------------------- encoder input


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir)
    manifest = staging.staged(_manifest(spark, sf_dir, masked=masked), "manifest")  # of known size, so that the planner may broadcast it
    return prep.sampled_cells(manifest, masked)


_SAMPLED = {
    "manifest": oracle.manifest(),
    "sampled": """SELECT m.sample_id, m.target_col_idx, m.co_missing_columns, c.table_id, c.row_idx, c.col_idx, c."column", c.value, c.is_null, c.is_numeric, c.missing, c.col_idx = m.target_col_idx AS is_target,
      list_contains(CAST(m.co_missing_columns AS VARCHAR[]), c."column") AND c.col_idx <> m.target_col_idx AS co_missing FROM manifest m JOIN masked c ON m.table_id = c.table_id AND m.row_idx = c.row_idx""".replace(
        "CAST(m.co_missing_columns AS VARCHAR[])", "from_json(m.co_missing_columns, '[\"VARCHAR\"]')"
    ),
}


def _sentence_sql(a: prep.Ablation) -> str:
    shown = "CASE WHEN is_target THEN '[?]' WHEN missing THEN '[EMPTY]' WHEN is_numeric AND TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE)) THEN CAST(TRY_CAST(value AS DOUBLE)::BIGINT AS VARCHAR) ELSE value END"
    name = oracle.normalized('"column"')
    header = {"strip": "''", "preserve": f"{name} || ': '", "only_target": f"CASE WHEN is_target THEN {name} || ': ' ELSE 'c' || place || ': ' END"}[a.header]
    rows = "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY col_idx) - 1 AS place FROM sampled" + (" WHERE NOT co_missing" if a.co_missing_drop else "")
    keep = "WHERE NOT is_target" if a.target == "remove" else ""
    return oracle.with_cells(f"""SELECT sample_id, string_agg({header} || {shown}, ', ' ORDER BY col_idx) AS sentence FROM ({rows}) {keep} GROUP BY sample_id""", oracle.draw(5, 5) | _SAMPLED)


def _register_sentences(a: prep.Ablation) -> None:
    @query(f"prep_sentences_{a.id}", _sentence_sql(a))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prep.sentences(_sampled(spark, sf_dir), a).select("sample_id", "sentence")


for _ablation in prep.ABLATIONS:
    _register_sentences(_ablation)


def _table_sql(a: prep.Ablation) -> str:
    name, cell = oracle.normalized('"column"'), oracle.normalized("CASE WHEN missing THEN 'n/a' ELSE value END")
    header = {"strip": "'c' || place", "preserve": name, "only_target": f"CASE WHEN is_target THEN {name} ELSE 'c' || place END"}[a.header]
    rows = "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY col_idx) - 1 AS place FROM sampled" + (" WHERE NOT is_target" if a.target == "remove" else "")
    return oracle.with_cells(f"""SELECT sample_id, string_agg({header} || '=' || CASE WHEN is_target THEN '[?]' ELSE {cell} END, ';' ORDER BY col_idx) AS cells, max(CASE WHEN is_target THEN place END)::INT AS target_position FROM ({rows}) GROUP BY sample_id""", oracle.draw(5, 5) | _SAMPLED)


def _register_tables(a: prep.Ablation) -> None:
    @query(f"prep_table_{a.id}", _table_sql(a))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = prep.tables(_sampled(spark, sf_dir), a)
        joined = F.array_join(F.transform("cells", lambda x: F.concat(x["header"], F.lit("="), x["cell"])), ";")
        return made.select("sample_id", joined.alias("cells"), "target_position")


for _ablation in prep.ABLATIONS[:4]:
    _register_tables(_ablation)


@query("drop_co_missing", oracle.with_cells("""SELECT sample_id, "column" FROM sampled WHERE NOT co_missing""", oracle.draw(5, 5) | _SAMPLED))
def drop_co_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).where(~F.col("co_missing")).select("sample_id", "column")


# ------------------------------------------------------------------------------- vectors

_UNIT = "list_transform({v}, lambda x: CASE WHEN sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))) > 0 THEN x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))) ELSE x::DOUBLE END)"
_SPLAT = "SELECT vec_id, pos, round(v[pos + 1], 6) + 0.0 AS x FROM (SELECT vec_id, {v} AS v FROM {src}) t, (SELECT unnest(range({n})) AS pos) p"


def _splat(df: DataFrame, vector: str = "v") -> DataFrame:
    return df.select("vec_id", F.posexplode(vector).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.load(spark, sf_dir, "embeddings")


_SCALED = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS e, list_slice(embedding, 1, 16) AS name FROM embeddings)"


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)).alias("e"), F.slice("embedding", 1, 16).alias("name"))


@query("l2_normalize", _SPLAT.format(v=_UNIT.format(v="e"), src=_SCALED, n=64))
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splat(_scaled(spark, sf_dir).select("vec_id", vectors.l2_normalize(F.col("e")).alias("v")))


_PADDED = f"list_concat({_UNIT.format(v='name')}, list_transform(range(48), lambda i: 0.0::DOUBLE))"
_MEANED = f"(SELECT vec_id, list_transform(list_zip({_UNIT.format(v='e')}, {_PADDED}), lambda z: (z[1] + z[2]) / 2) AS m FROM {_SCALED})"


@query("meanpool", _SPLAT.format(v=_UNIT.format(v="m"), src=_MEANED, n=64))
def meanpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splat(_scaled(spark, sf_dir).select("vec_id", vectors.mean_pool(F.col("e"), F.col("name"), 64).alias("v")))


@query("pad_vectors", _SPLAT.format(v="list_concat(list_transform(name, lambda x: x::DOUBLE), list_transform(range(48), lambda i: 0.0::DOUBLE))", src=_SCALED, n=64))
def pad_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splat(_scaled(spark, sf_dir).select("vec_id", vectors.pad(F.col("name"), 64).alias("v")))


#: A tensor of 2 layers, 2 heads and 4 x 4 weights of each vector; one in five is all zeros.
_TENSORS = """
SELECT vec_id, layer, head, q, pos, abs(embedding[layer * 32 + head * 16 + q * 4 + pos + 1]::DOUBLE) * (vec_id % 5) AS x
FROM embeddings, (SELECT unnest(range(2)) AS layer), (SELECT unnest(range(2)) AS head), (SELECT unnest(range(4)) AS q), (SELECT unnest(range(4)) AS pos)
"""
_WEIGHTS = f"""
WITH tensors AS ({_TENSORS}),
wanted AS (
  SELECT *, true AS renormalised, x / greatest(sum(x) OVER (PARTITION BY vec_id, layer, head, q), 1e-6) AS w FROM tensors WHERE layer = 1
  UNION ALL SELECT *, false, x * 1e-4 FROM tensors WHERE head = 0
),
steps AS (SELECT *, pow(2, greatest(CASE WHEN w > 0 THEN floor(log2(w)) ELSE -14 END, -14) - 10) AS step FROM wanted)
SELECT vec_id, renormalised, layer::INT AS layer, head::INT AS head, q::INT AS q, pos::INT AS pos, round_even(w / step, 0) * step AS weight FROM steps
"""


@query("attention_weights", _WEIGHTS)
def attention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last layer's heads with rows that sum to one, and the first head of both layers as it is, in half precision."""
    size = lambda k: F.abs(F.col("embedding")[k].cast("double")) * (F.col("vec_id") % 5)
    tensor = F.array(*[F.array(*[F.array(*[F.array(*[size(a * 32 + h * 16 + q * 4 + p) for p in range(4)]) for q in range(4)]) for h in range(2)]) for a in range(2)])
    tensors = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), tensor.alias("attention"))
    small = tensors.withColumn("attention", F.transform("attention", lambda a: F.transform(a, lambda h: F.transform(h, lambda r: F.transform(r, lambda x: x * 1e-4)))))
    rows = embed.attentions(tensors, layers=[-1]).withColumn("renormalised", F.lit(True)).unionByName(embed.attentions(small, heads=[0], renormalise=False).withColumn("renormalised", F.lit(False)))
    each = rows.select(F.col("sample_id").alias("vec_id"), "renormalised", "layer", "head", F.posexplode("weights").alias("q", "row"))
    return each.select("vec_id", "renormalised", "layer", "head", "q", F.posexplode("row").alias("pos", "weight")).withColumn("weight", F.col("weight").cast("double"))


@query("group_mean_embedding", "SELECT label, pos, round(avg(embedding[pos + 1]::DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(64)) AS pos) p GROUP BY label, pos")
def group_mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.group_mean(_embeddings(spark, sf_dir), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_WIDE = f"""
SELECT sample_id, table_id, column_type, row_idx, row_number() OVER (PARTITION BY table_id, column_type ORDER BY sample_id) - 1 AS row_in_table, (missing_kind <> 'present')::INT AS y, special_token,
  {", ".join(f"e.embedding[{i + 1}] AS {name}" for i, name in enumerate(vectors.embedding_names(64)))}
FROM manifest m JOIN embeddings e ON e.vec_id = m.sample_id
"""


@query("pred_dataset_wide", oracle.with_cells(_WIDE, oracle.draw(5, 5) | {"manifest": oracle.manifest()}))
def pred_dataset_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = _manifest(spark, sf_dir).join(_embeddings(spark, sf_dir).withColumnRenamed("vec_id", "sample_id"), "sample_id")
    return vectors.prediction_dataset(embedded, 64)


def _hashed_sql(inputs: str, share: str) -> str:
    """Prediction rows from ``inputs`` (sample_id, at, text): signed sums of words by place, ``share`` of each, in the columns of the wide dataset."""
    columns = ", ".join(f"coalesce(max(CASE WHEN place = {i} THEN x END), 0)::FLOAT AS {name}" for i, name in enumerate(vectors.embedding_names(384)))
    ctes = {
        "manifest": oracle.manifest(), "sampled": _SAMPLED["sampled"], "inputs": inputs,
        "word": r"SELECT sample_id, unnest(string_split_regex(trim(text), '\s+')) AS w FROM inputs WHERE text <> ''",
        "summed": "SELECT sample_id, ('0x' || md5(w)[1:8])::BIGINT % 384 AS place, sum(CASE WHEN md5(w)[9] < '8' THEN 1 ELSE -1 END)::DOUBLE AS s, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM word) GROUP BY ALL",
        "hashed": f"SELECT sample_id, place, s / {share} AS x FROM summed",
    }
    body = f"""SELECT sample_id, table_id, column_type, row_idx, row_number() OVER (PARTITION BY table_id, column_type ORDER BY sample_id) - 1 AS row_in_table, (missing_kind <> 'present')::INT AS y, special_token, {columns}
    FROM manifest LEFT JOIN hashed USING (sample_id) GROUP BY sample_id, table_id, column_type, row_idx, missing_kind, special_token"""
    return oracle.with_cells(body, oracle.draw(5, 5) | ctes)


_SENTENCES = "SELECT sample_id, string_agg({name} || ': ' || CASE WHEN is_target THEN '[?]' WHEN missing THEN '[EMPTY]' WHEN is_numeric AND TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE)) THEN CAST(TRY_CAST(value AS DOUBLE)::BIGINT AS VARCHAR) ELSE value END, ', ' ORDER BY col_idx) AS text FROM sampled GROUP BY sample_id".replace(
    "{name}", oracle.normalized('"column"')
)


@query("embed_hash", _hashed_sql(_SENTENCES, "sqrt(sum(s * s) OVER (PARTITION BY sample_id))"))
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prep.sentences(_sampled(spark, sf_dir), prep.ABLATIONS[0])
    return vectors.prediction_dataset(embed.embed_column(made, "sentence", "hashing", "hashing", 384), 384)


@query("embed_table_hash", _hashed_sql(f"""SELECT sample_id, {oracle.normalized('"column"')} || ' [?]' AS text FROM sampled WHERE is_target""", "n"))
def embed_table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prep.tables(_sampled(spark, sf_dir), prep.ABLATIONS[0])
    return vectors.prediction_dataset(embed.embed_tables(made, "hashing_table", "hashing", 384), 384)


_CELL_MEAN = "SELECT label, vec_id % 3 AS col_idx, pos, avg(embedding[pos + 1]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS pos) p GROUP BY ALL"


@query("cell_vectors", f"SELECT label AS sample_id, col_idx, pos, round(x, 6) + 0.0 AS x FROM ({_CELL_MEAN})")
def cell_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens_of = _embeddings(spark, sf_dir).select(F.col("label").alias("sample_id"), F.lit(1).alias("row_id"), (F.col("vec_id") % 3).alias("col_idx"), F.col("embedding").alias("vector"))
    made = embed.cell_vectors(tokens_of, 64).select("sample_id", "col_idx", F.posexplode("embedding").alias("pos", "x"))
    return made.select("sample_id", "col_idx", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query("row_vectors", f"SELECT label AS sample_id, pos, round(avg(x), 6) + 0.0 AS x FROM ({_CELL_MEAN}) GROUP BY ALL")
def row_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens_of = _embeddings(spark, sf_dir).select(F.col("label").alias("sample_id"), F.lit(1).alias("row_id"), (F.col("vec_id") % 3).alias("col_idx"), F.col("embedding").alias("vector"))
    header = tokens_of.withColumn("row_id", F.lit(0))  # the header row has no part in it
    made = embed.row_vectors(embed.cell_vectors(tokens_of.union(header), 64)).select("sample_id", F.posexplode("embedding").alias("pos", "x"))
    return made.select("sample_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query("table_round_trip", oracle.with_cells("SELECT row_idx, max(value) FILTER (col_idx = 0 AND NOT is_null) AS quality, max(value) FILTER (col_idx = 2 AND NOT is_null) AS lang FROM cells WHERE table_id = 'doc_labels' GROUP BY row_idx"))
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table_of(fixtures.cells(spark, sf_dir), "doc_labels", ["quality", "toxic", "lang"]).select("row_idx", "quality", "lang")


# ------------------------------------------------------------------------------- orchestration


@query("shard_union", "SELECT n_nationkey AS key, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = fixtures.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    other = fixtures.load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("note"))
    return sampling.append(one, other)


@query("resume_anti_join", """SELECT DISTINCT source, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 4 = 0 AND x.source = d.source AND x.lang = d.lang)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.load(spark, sf_dir, "documents")
    entries = docs.where("doc_id % 4 = 0").select("source", "lang", F.lit("done").alias("state"), F.col("doc_id").alias("at"))
    return ledger.open_work(docs.select("source", "lang").distinct(), entries, ["source", "lang"])


_LEDGER = """
WITH entries AS (SELECT source, n_chars % 50 AS piece, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'done' END AS state, doc_id AS t FROM documents WHERE doc_id % 4 <> 1),
last AS (SELECT source, piece, max_by(state, t) AS state FROM entries GROUP BY ALL)
SELECT source, piece, l.state, l.state IS NULL AS open, coalesce(l.state <> 'done', true) AS open_again FROM (SELECT DISTINCT source, n_chars % 50 AS piece FROM documents) LEFT JOIN last l USING (source, piece)
"""


@query("run_ledger", _LEDGER)
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an entry about a piece of work: which pieces are open, and which are with failed ones tried again."""
    docs, keys = fixtures.load(spark, sf_dir, "documents").withColumn("piece", F.col("n_chars") % 50), ["source", "piece"]
    entries = docs.where("doc_id % 4 <> 1").select(*keys, F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("done").alias("state"), F.col("doc_id").alias("at"))
    wanted = docs.select(*keys).distinct()
    out = wanted.join(ledger.latest(entries, keys), keys, "left")
    for name, again in (("open", False), ("open_again", True)):
        out = out.join(ledger.open_work(wanted, entries, keys, again).withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


_DIGEST = """
WITH shown AS (SELECT source, md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(length(lang) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(length(text) || ':' || text, '-')) AS h FROM documents)
SELECT source, count(*) AS n, (sum(('0x' || h[1:16])::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR AS upper, (sum(('0x' || h[17:32])::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR AS lower FROM shown GROUP BY source
"""


@query("multiset_digest", _DIGEST)
def multiset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that guards a manifest, of all documents by source."""
    return runner.multiset_digest(fixtures.load(spark, sf_dir, "documents"), ["source"])


#: Every occurrence is a cell of the same relation, so what the lookup finds is the cell's own value.
@query("occurrence_lookup", oracle.with_cells(f"""SELECT {_K}, CASE WHEN kind IS NOT NULL THEN value END AS occurrence FROM classified"""))
def occurrence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cells(spark, sf_dir)
    return tokens.with_occurrence_labels(cells, staging.staged(tokens.occurrences(cells), "occurrences")).select(*KEYS, "occurrence")


_LIST = """SELECT source || '.parquet' AS file_basename, lang AS "column", doc_id % 40 AS row_idx, max_by('said "' || doc_id || '", ' || chr(10) || 'a', doc_id) AS occurrence FROM documents GROUP BY ALL"""


@query("occurrence_list", _LIST)
def occurrence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of all documents as entries, written as CSV in the order of doc_id and read back: of a cell's entries the last counts."""
    value = F.concat(F.lit('said "'), F.col("doc_id").cast("string"), F.lit('", \na'))
    rows = fixtures.load(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".parquet")).alias("file"), F.col("lang").alias("column"), (F.col("doc_id") % 40).alias("row_idx"), value.alias("original_value"))
    path = f"{staging.shared_dir(spark)}/occurrences-{uuid.uuid4().hex}"
    rows.orderBy("doc_id").drop("doc_id").write.options(**occurrences.CSV).csv(path)
    return occurrences.last_entries(occurrences.read_occurrences(spark, path)[0])


_CLEAN = {t: ", ".join(f"""{oracle.normalized(f"CAST({c} AS VARCHAR)")} AS v{k}""" for k, c in enumerate(fixtures.COLUMNS[t][:5])) for t in ("customer", "part")}


@query("clean_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_id, {columns} FROM {t}" for t, columns in _CLEAN.items()))
def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean tables written one for each file and read back: the first five columns of two of them."""
    folder, out = f"{staging.shared_dir(spark)}/clean-{uuid.uuid4().hex}", None
    runner.clean_corpus(spark, sf_dir, folder, tables=["region", "nation", *_CLEAN])
    for table in _CLEAN:
        found = spark.read.parquet(f"{folder}/{table}.parquet")
        names = [tx.normalize(F.lit(c)) for c in fixtures.COLUMNS[table][:5]]
        shown = spark.range(1).select(*[n.alias(str(k)) for k, n in enumerate(names)]).first()
        part = found.select(F.lit(table).alias("table_id"), *[F.col(f"`{n}`").alias(f"v{k}") for k, n in enumerate(shown)])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "prior_state_counts",
    oracle.with_cells("SELECT file_basename, count(DISTINCT target_col)::INT AS run_index FROM manifest GROUP BY file_basename", oracle.draw(5, 5) | {"manifest": oracle.manifest()}),
)
def prior_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.prior_state(_manifest(spark, sf_dir))["runs"]


@query(
    "prior_state_last_run",
    oracle.with_cells("SELECT file_basename, (max(run_index) + 1)::INT AS run_index FROM manifest GROUP BY file_basename", oracle.draw(5, 5) | {"manifest": oracle.manifest()}),
)
def prior_state_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.prior_state(_manifest(spark, sf_dir), "last")["runs"]


def _scan_sql() -> str:
    """Cells and nulls of every table."""
    parts = []
    for table, names in fixtures.COLUMNS.items():
        n = f"count(*) * {len(names)}"
        parts.append(f"SELECT '{table}' AS table_id, {n} AS n_cells, {n} - ({' + '.join(f'count({c})' for c in names)}) AS n_null FROM {table}")
    return " UNION ALL ".join(parts)


#: Two columns of every table, whole numbers and texts.
_TWO = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_name", "n_regionkey"), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_suppkey", "s_name"), "part": ("p_name", "p_size"), "orders": ("o_custkey", "o_orderpriority"),
    "lineitem": ("l_linenumber", "l_returnflag"), "events": ("user_id", "event_type"), "documents": ("lang", "source"), "embeddings": ("vec_id", "label"), "pages": ("page_id", "url"), "benchmark": ("item_id", "text"),
    "labels": ("quality", "toxic"), "conversations": ("turn", "role"),
}
_TWO_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_id, '{c}' AS "column", count(*) AS n_cells, count(*) - count({c}) AS n_null, sum(length({c}::VARCHAR))::BIGINT AS n_chars, min({c}::VARCHAR) AS first, max({c}::VARCHAR) AS last FROM {t}""" for t, names in _TWO.items() for c in names
)


@query("corpus_two_columns", _TWO_SQL)
def corpus_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two columns of every table; the reader leaves the others' bytes unread."""
    cells, _ = corpus.read_corpus(spark, sf_dir, tables=sorted(_TWO), columns=sorted({c for names in _TWO.values() for c in names}))
    asked = F.struct("table_id", "column").isin([F.struct(F.lit(t), F.lit(c)) for t, names in _TWO.items() for c in names])
    found = cells.where(asked).groupBy("table_id", "column")
    return found.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("is_null").alias("n_null"), F.sum(F.length("value")).alias("n_chars"), F.min("value").alias("first"), F.max("value").alias("last"))


@query("corpus_scan", _scan_sql())
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder reader over every file of the folder."""
    cells, _ = corpus.read_corpus(spark, sf_dir)
    return cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("is_null")).alias("n_null"))
