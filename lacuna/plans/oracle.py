"""DuckDB texts of the rules, for the side-by-side checks; they hold on ASCII cells."""

from __future__ import annotations

from lacuna.functions import lexicon as lx
from lacuna.plans.fixtures import TABLES, cells_sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return ", ".join(quoted(v) for v in values)


_S, _W = r"\s", r"\w"


def _pattern(text: str) -> str:
    return text.replace(f"{lx.WORD}", _W).replace(f"{lx.SPACE}", _S).replace(r"[\s\S]", "(?s:.)")


PATTERNS = [(name, _pattern(p)) for name, p in lx.DISGUISED_PATTERNS]


def stripped(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def missing(v: str = "value", null: str = "is_null") -> str:
    s = stripped(v)
    any_pattern = "|".join(f"(?:{p})" for _, p in PATTERNS)
    numbers = ", ".join(map(str, lx.NUMERIC_SENTINELS))
    return f"""coalesce({null} OR {s} = '' OR lower({s}) IN ({strings(lx.DISGUISED_LITERALS)}) OR regexp_full_match(lower({s}), {quoted(any_pattern)}) OR coalesce(TRY_CAST({s} AS DOUBLE) IN ({numbers}), false), true)"""


def label(v: str = "value") -> str:
    whens = " ".join(f"WHEN regexp_full_match(lower({stripped(v)}), {quoted(p)}) THEN {quoted(name)}" for name, p in PATTERNS)
    return f"CASE {whens} END"


#: kind and label of cells, by the column's type.
CLASSIFIED = f"""
SELECT *, CASE WHEN kind IN ('literal', 'date_sentinel') THEN lower({stripped("value")}) WHEN kind = 'regex' THEN pattern WHEN kind = 'numeric_sentinel' THEN CAST(CAST(value AS DOUBLE)::BIGINT AS VARCHAR) END AS label
FROM (
  SELECT *, CASE WHEN is_null THEN NULL
    WHEN is_numeric THEN CASE WHEN TRY_CAST(value AS DOUBLE) IN ({", ".join(map(str, lx.NUMERIC_SENTINELS))}) THEN 'numeric_sentinel' END
    WHEN {stripped("value")} = '' THEN NULL
    WHEN lower({stripped("value")}) IN ({strings(lx.DISGUISED_LITERALS)}) THEN 'literal'
    WHEN pattern IS NOT NULL THEN 'regex'
    WHEN lower({stripped("value")}) IN ({strings(lx.DATE_SENTINELS)}) THEN 'date_sentinel' END AS kind
  FROM (SELECT *, {label()} AS pattern FROM masked)
)
"""

CELL = f"""
SELECT *, CASE WHEN is_null THEN 'nan' WHEN missing THEN 'disguised' ELSE 'present' END AS missing_kind,
  CASE WHEN is_null THEN NULL WHEN kind IS NOT NULL AND kind <> 'date_sentinel' THEN label WHEN missing AND NOT is_numeric AND {stripped("value")} = '' THEN 'empty string' END AS special_token,
  CASE WHEN is_null THEN '' ELSE value END AS original_value
FROM classified
"""


def normalized(v: str) -> str:
    """The normal form of an ASCII text."""
    out = stripped(v)
    steps = [
        (r"\s*\|\s*", " "), (r"\b([A-Za-z])\.\s*([A-Za-z])\.", r"\1\2"), (r"[_\-]+", " "), (r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"\s+", " "),
    ]
    for pattern, by in steps:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
    keys, values = strings(lx.ABBREVIATIONS), strings(lx.ABBREVIATIONS.values())
    out = rf"array_to_string(list_transform(regexp_extract_all(trim({out}), '\w+|\W+'), lambda t: coalesce([{values}][list_position([{keys}], lower(t))], t)), '')"
    kept = rf"regexp_full_match(t, '[A-Z0-9]+') AND regexp_matches(t, '[A-Z]') AND (length(t) <= 3 OR t IN ({strings(lx.ACRONYMS)}))"
    return rf"array_to_string(list_transform(regexp_extract_all({out}, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda t: CASE WHEN {kept} THEN t ELSE lower(t) END), '')"


def column_type(v: str) -> str:
    keys, values = strings(lx.COLUMN_TYPE_NAMES), strings(lx.COLUMN_TYPE_NAMES.values())
    return f"coalesce([{values}][list_position([{keys}], {normalized(v)})], {normalized(v)})"


PROFILE = rf"""
SELECT table_id, file_basename, col_idx, "column", is_numeric, count(*) FILTER (missing) AS n_missing, count(*) FILTER (NOT missing) AS n_present, count(*) FILTER (missing AND NOT is_null) AS n_disguised,
  count(DISTINCT value) FILTER (NOT missing) AS n_unique_present,
  coalesce(count(DISTINCT value) FILTER (NOT missing) / nullif(count(*) FILTER (NOT missing), 0), 0)::DOUBLE AS uniq_frac,
  coalesce(sum(length(value)) FILTER (NOT missing) / nullif(count(*) FILTER (NOT missing), 0), 0)::DOUBLE AS mean_present_len,
  coalesce(count(*) FILTER (NOT missing AND regexp_full_match(value, '\s*(?:[^:;,]+:\s*<?\s*\d+(?:\.\d+)?\s*%?\s*[;,]?\s*){{2,}}')) / nullif(count(*) FILTER (NOT missing), 0), 0)::DOUBLE AS agg_frac
FROM masked GROUP BY ALL
"""


def eligible(min_n: int = 5, strict: bool = False, blocked: tuple[tuple[str, str], ...] = lx.BLOCKED_COLUMNS) -> str:
    names = " OR ".join(f"""(file_basename = {quoted(f)} AND "column" = {quoted(c)})""" for f, c in blocked) or "false"
    internal = r"(?:__index_level_\d+__|__pandas\w*|Unnamed:\s*\d+)" if strict else r"(?i:__index_level_\d+__|__pandas\w*|Unnamed:\s*\d+|unnamed(?::\s*|\s+column\s+)\d+)"
    head = "" if strict else f"WHEN {names} THEN 'blocked_bad_parse'"
    tail = "WHEN uniq_frac >= 0.95 THEN 'unique_id' WHEN mean_present_len > 60 THEN 'free_text' WHEN agg_frac >= 0.10 THEN 'aggregate_column'" if strict else ""
    return f"""SELECT *, CASE {head} WHEN regexp_full_match("column", {quoted(internal)}) THEN 'internal_column' WHEN n_missing < {min_n} THEN 'lt_n_missing' WHEN n_present < {min_n} THEN 'lt_n_present' WHEN n_unique_present <= 1 THEN 'constant' {tail} END AS reason FROM profile"""


def priority(v: str) -> str:
    return f"regexp_matches({normalized(v)}, {quoted(lx.PRIORITY_PATTERN)})"


PAIRS = """
SELECT a.table_id, a.file_basename, a.col_idx, a."column", b.col_idx AS other_idx, b."column" AS other
FROM (SELECT table_id, file_basename, col_idx, "column", list(row_idx ORDER BY row_idx) AS r FROM masked WHERE missing GROUP BY ALL) a
JOIN (SELECT table_id, file_basename, col_idx, "column", list(row_idx ORDER BY row_idx) AS r FROM masked WHERE missing GROUP BY ALL) b
  ON a.table_id = b.table_id AND a.file_basename = b.file_basename AND a.r = b.r AND a."column" <> b."column"
"""

LISTS = """SELECT table_id, file_basename, col_idx, '["' || string_agg(other, '","' ORDER BY other_idx) || '"]' AS co_missing_columns FROM pairs GROUP BY ALL"""


def with_cells(body: str, more: dict[str, str] | None = None, names: tuple[str, ...] = tuple(TABLES), min_n: int = 5, recursive: bool = False) -> str:
    """``body`` after the common table expressions cells, masked, classified, cell, profile, eligible, pairs, lists and ``more``."""
    ctes = {
        "cells": cells_sql(names), "masked": f"SELECT *, {missing()} AS missing FROM cells", "classified": CLASSIFIED, "cell": CELL, "profile": PROFILE, "eligible": eligible(min_n),
        "pairs": PAIRS, "lists": LISTS,
    } | (more or {})
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + f"\n{body}"


def draw(n: int, min_n: int, seed: int = 42, run: str = "0", used: str = "", skip: str = "", use_priority: bool = False, cap: int = 20, prior: str = "0") -> dict[str, str]:
    """The expressions ranked, pool, sized, able and drawn of a draw of one column per table."""
    first = f"CASE WHEN {priority(chr(34) + 'column' + chr(34))} THEN 0 ELSE 1 END" if use_priority else "0"
    return {
        "ranked": f"""SELECT *, {run} AS run_index, row_number() OVER (PARTITION BY table_id, file_basename ORDER BY {first}, md5('{seed}|' || {run} || '|' || file_basename || '|' || "column"), col_idx) AS column_rank FROM eligible WHERE reason IS NULL {skip}""",
        "pool": f"""SELECT c.*, r.column_rank, r.run_index, row_number() OVER (PARTITION BY c.table_id, c.file_basename, c.col_idx, c.missing ORDER BY md5('{seed}|' || r.run_index || '|' || c.file_basename || '|' || c."column" || '|' || c.row_idx), c.row_idx) AS ord FROM cell c JOIN ranked r ON c.table_id = r.table_id AND c.file_basename = r.file_basename AND c.col_idx = r.col_idx {used}""",
        "sized": f"""SELECT *, least({n}, count(*) FILTER (missing) OVER w, count(*) FILTER (NOT missing) OVER w) AS drawn FROM pool WINDOW w AS (PARTITION BY table_id, file_basename, col_idx)""",
        "able": f"""SELECT *, min(column_rank) OVER (PARTITION BY table_id, file_basename) AS best FROM sized WHERE drawn >= {min_n} AND {prior} + 2 * drawn <= {cap}""",
        "drawn": "SELECT * FROM able WHERE column_rank = best AND ord <= drawn",
    }


def draw_many(n: int, min_n: int, columns: int, cap: int = 20) -> dict[str, str]:
    """The expressions of a draw of several columns per table, column by column over the rows that are not used yet."""
    one = draw(n, min_n)
    free = "list_filter(c.{x}, lambda v: NOT list_contains(g.used, v)) AS {x}"
    row = "SELECT table_id, file_basename, col_idx, unnest({x}) AS row_idx, unnest(range(1, len({x}) + 1)) AS ord FROM picked WHERE col_idx IS NOT NULL"
    return {k: one[k] for k in ("ranked", "pool")} | {
        "columns": """SELECT table_id, file_basename, col_idx, column_rank, coalesce(list(row_idx ORDER BY ord) FILTER (missing), []) AS m, coalesce(list(row_idx ORDER BY ord) FILTER (NOT missing), []) AS p FROM pool GROUP BY ALL""",
        "picked": f"""SELECT DISTINCT table_id, file_basename, 0::BIGINT AS column_rank, 0 AS taken, NULL::INTEGER AS col_idx, []::BIGINT[] AS used, []::BIGINT[] AS m, []::BIGINT[] AS p FROM columns
      UNION ALL SELECT table_id, file_basename, column_rank, taken + able::INTEGER, CASE WHEN able THEN col_idx END, CASE WHEN able THEN list_concat(used, m[1:size], p[1:size]) ELSE used END, m[1:size], p[1:size]
      FROM (SELECT *, least({n}, len(m), len(p)) AS size, taken < {columns} AND least({n}, len(m), len(p)) >= {min_n} AND 2 * least({n}, len(m), len(p)) <= {cap} AS able
        FROM (SELECT c.table_id, c.file_basename, c.column_rank, g.taken, c.col_idx, g.used, {free.format(x="m")}, {free.format(x="p")} FROM picked g JOIN columns c ON c.table_id = g.table_id AND c.file_basename = g.file_basename AND c.column_rank = g.column_rank + 1))""",
        "drawn": f"""SELECT q.* REPLACE (u.ord AS ord) FROM pool q JOIN ({row.format(x="m")} UNION ALL {row.format(x="p")}) u ON q.table_id = u.table_id AND q.file_basename = u.file_basename AND q.col_idx = u.col_idx AND q.row_idx = u.row_idx""",
    }


def manifest(seed: int = 42, first_id: int = 0, source: str = "drawn") -> str:
    """The manifest's columns from a draw."""
    return f"""
SELECT (row_number() OVER (ORDER BY d.file_basename, column_rank, 2 * (ord - 1) + CASE WHEN missing THEN 0 ELSE 1 END) + {first_id - 1})::BIGINT AS sample_id, 'datasets/' || d.file_basename AS file, d.file_basename, d.table_id,
  {column_type('d."column"')} AS column_type, d."column" AS target_col, d.col_idx AS target_col_idx, row_idx, missing::INT AS y, missing AS is_missing, missing_kind, special_token, original_value,
  coalesce(l.co_missing_columns, '[]') AS co_missing_columns, {seed} AS random_state, run_index
FROM {source} d LEFT JOIN lists l ON d.table_id = l.table_id AND d.col_idx = l.col_idx
"""
