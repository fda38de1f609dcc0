"""Tables with missing cells, derived from the fixture tables by the same SQL text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.profile import with_mask
from lacuna.sources.corpus import cells_of, spread

#: Nulls, placeholders, sentinels and co-missing columns by key arithmetic on orders. ``{orders}`` is the source.
DIRTY_SQL = """
SELECT o_orderkey AS row_idx,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'Unknown' WHEN o_orderkey % 13 = 0 THEN ' N/A ' WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'not available' WHEN o_orderkey % 9 = 0 THEN 'unknown method' WHEN o_orderkey % 14 = 1 THEN 'not available today' ELSE o_orderpriority END AS note,
  CASE WHEN o_orderkey % 19 = 0 THEN -999.0 WHEN o_orderkey % 23 = 0 THEN 9999.0 ELSE CAST(o_orderkey % 1000 AS DOUBLE) + 0.5 END AS amount,
  CASE WHEN o_orderkey % 19 = 0 THEN '-999' WHEN o_orderkey % 23 = 0 THEN '-9.' WHEN o_orderkey % 29 = 0 THEN '9999d' ELSE CAST(o_orderkey % 50 AS STRING) END AS amount_txt,
  CASE WHEN o_orderkey % 29 = 0 THEN '1970-01-01' WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat('2001-01-', CAST(10 + o_orderkey % 20 AS STRING)) END AS due_date,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey % 100 END AS twin_a,
  CASE WHEN o_orderkey % 31 = 0 THEN 'tbd' ELSE o_orderstatus END AS "twinB",
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'k' END AS constant,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE concat('key ', CAST(o_orderkey AS STRING)) END AS id,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE concat('a longer remark about order number ', CAST(o_orderkey % 10 AS STRING), ' that says more than sixty characters') END AS free_text,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE concat('A:', CAST(o_orderkey % 9 AS STRING), '; B:2') END AS counts,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS "Unnamed: 0"
FROM {orders}
"""

#: Labels that only some documents have: two columns that are missing together.
LABELLED_SQL = """
SELECT d.doc_id AS row_idx, l.quality, l.toxic, d.lang, d.source, d.n_chars
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

TABLES = {
    "orders_dirty": (DIRTY_SQL, ("orders",), ("status", "note", "amount", "amount_txt", "due_date", "twin_a", "twinB", "constant", "id", "free_text", "counts", "Unnamed: 0"), {"amount", "twin_a"}),
    "doc_labels": (LABELLED_SQL, ("documents", "labels"), ("quality", "toxic", "lang", "source", "n_chars"), {"quality", "toxic", "n_chars"}),
}


#: The columns of the folder's own tables.
COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"), "documents": ("doc_id", "text", "lang", "source", "n_chars"), "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"), "conversations": ("conv_id", "turn", "role", "text"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``TABLES`` as a wide table with row_idx."""
    sql, sources, _, _ = TABLES[name]
    return spark.sql(sql.replace('"', "`"), **{s: load(spark, sf_dir, s) for s in sources})


def cells(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    """The cell relation of the named tables."""
    out = None
    for name in names:
        found = cells_of(spread(table(spark, sf_dir, name)), name, F.col("row_idx"), list(TABLES[name][2]))
        # row_idx is no column of the table, so columns are numbered without it
        out = found if out is None else out.unionByName(found)
    return out


def masked(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(TABLES)) -> DataFrame:
    return with_mask(cells(spark, sf_dir, names))


def cells_sql(names: tuple[str, ...] = tuple(TABLES)) -> str:
    """``cells`` in DuckDB, as the text of a common table expression's body."""
    parts = []
    for name in names:
        sql, sources, columns, numeric = TABLES[name]
        body = sql.format(**{s: s for s in sources})
        for k, c in enumerate(columns):
            flag = str(c in numeric).lower()
            parts.append(f"""SELECT '{name}' AS table_id, '{name}.parquet' AS file_basename, row_idx::BIGINT AS row_idx, {k} AS col_idx, '{c}' AS "column", {flag} AS is_numeric, CAST("{c}" AS VARCHAR) AS value, "{c}" IS NULL AS is_null FROM ({body})""")
    return "\nUNION ALL ".join(parts)
