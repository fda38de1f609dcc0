"""A corpus of arbitrary Parquet tables as one long relation of cells.

``cells``: table_id, file_basename, row_idx, col_idx, column, is_numeric, value (text form), is_null. Every
operator before the encoders is a set operation over this relation.

``read_corpus`` reads a folder of heterogeneous files by the data source ``cells``, which splits files and reads only the columns asked for; a
file that cannot be read to its end becomes an audit row and has no cells. Large
tables of known schema are read by Spark's own scan with ``cells_of``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.text import let
from lacuna.sources.cell_source import CELLS, CellSource, cells_of_range, check_part, error_row
from lacuna.sources.staging import staged

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)


def _digits(number: Column) -> Column:
    """A double as the JVM shows it, but with the fewest digits that give the same number; before Java 19 the JVM sometimes shows more.

    Of subnormal numbers the JVM shows two digits at least, of 17 digits not always the nearest; they are the same number.
    """

    def shorter(shown: Column) -> Column:
        def java(text: Column) -> Column:
            mantissa = F.rtrim(F.substring_index(text, "e", 1), F.lit("0"))
            return F.concat(mantissa, F.when(mantissa.endswith("."), "0").otherwise(""), F.lit("E"), F.substring_index(text, "e", -1).cast("int").cast("string"))

        tries = [F.format_string(f"%.{digits - 1}e", number) for digits in (15, 16, 17)]
        return F.when(F.length(shown) > 17, F.coalesce(*[F.when(t.cast("double") == number, java(t)) for t in tries], shown)).otherwise(shown)

    return let(number.cast("string"), shorter)


def float_text(number: Column) -> Column:
    """A float's digits as Python shows them: plain from 1e-4 up to 1e16, else with an exponent of two digits or more."""

    def python(shown: Column) -> Column:
        size = F.abs(number)
        exponent = F.regexp_extract(shown, r"E-?(\d+)", 1)
        sign = F.when(shown.contains("E-"), "e-").otherwise("e+")
        powered = F.concat(F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", ""), sign, F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent))
        return (
            F.when((((size >= 1e-3) & (size < 1e7)) | (size == 0)) & ~shown.contains("E"), shown)
            .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
            .when((size >= 1e16) | (size < 1e-4), powered)
            .when(number == F.rint(number), F.concat(number.cast("long").cast("string"), F.lit(".0")))
            .otherwise(F.rtrim(shown.cast("decimal(38,21)").cast("string"), F.lit("0")))
        )

    # The JVM's text is the one wanted for most numbers; the functions on arrays that bind it for the rest are interpreted.
    shown, size = number.cast("string"), F.abs(number)
    return F.when((((size >= 1e-3) & (size < 1e7)) | (size == 0)) & (F.length(shown) <= 17), shown).otherwise(let(_digits(number), python))


def _widened(single: Column) -> Column:
    """The double of a single-precision float's shortest digits; the JVM's are tried first, as before Java 19 they may be too many."""
    shown = single.cast("string")
    tries = [F.format_string(f"%.{digits - 1}e", single.cast("double")) for digits in (6, 7, 8)]
    fewest = F.coalesce(*[F.when(t.cast("float") == single, t) for t in tries], shown)
    return F.when(F.length(shown) > 8, fewest).otherwise(shown).cast("double")


def _text(column: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The text form of a column's cells, and whether they are null; NaN is null."""
    null = column.isNull()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        null = null | F.isnan(column)
        double = _widened(column) if isinstance(kind, T.FloatType) else column
        return F.when(~null, float_text(double)), null
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.substring_index(column.cast("string"), ".", 1), F.when(F.date_format(column, "SSSSSS") == "000000", "").otherwise(F.date_format(column, ".SSSSSS"))), null
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string")), null
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column), null
    return column.cast("string"), null


def spread(df: DataFrame, at_most: int = 8) -> DataFrame:
    """The rows dealt to more tasks if a scan has fewer than the cluster's cores, by a factor of ``at_most``.

    Text rules cost far more than moving rows, and a file of one row group is one task. Large tables have enough
    splits and are left as they are.
    """
    tasks, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, at_most * max(1, tasks))) if tasks < cores else df


def cells_of(df: DataFrame, table_id: str, row_idx: Column, columns: list[str] | None = None) -> DataFrame:
    """The cells of one table in a single scan; ``row_idx`` must identify its rows."""
    names = [c for c in df.columns if columns is None or c in columns]
    # Texts are columns of their own first: within the generator, one interpreted function would make all of it interpreted.
    texts, parts = [row_idx.cast("long").alias("row_idx")], []
    for k, name in enumerate(names):
        kind = df.schema[name].dataType
        value, null = _text(F.col(f"`{name}`"), kind)
        texts += [value.alias(f"value{k}"), null.alias(f"null{k}")]
        numeric = F.lit(isinstance(kind, _NUMERIC))
        parts.append(F.struct(F.lit(k).alias("col_idx"), F.lit(name).alias("column"), numeric.alias("is_numeric"), F.col(f"value{k}").alias("value"), F.col(f"null{k}").alias("is_null")))
    rows = df.select(*texts).select(F.lit(table_id).alias("table_id"), F.lit(f"{table_id}.parquet").alias("file_basename"), "row_idx", F.explode(F.array(*parts)).alias("cell"))
    return rows.select("table_id", "file_basename", "row_idx", "cell.*")


def table_of(cells: DataFrame, table_id: str, columns: list[str]) -> DataFrame:
    """One table of the cell relation as a wide table again: row_idx and its text columns, by position."""
    rows = cells.where(F.col("table_id") == table_id)
    wide = rows.groupBy("row_idx").agg(*[F.max(F.when((F.col("col_idx") == k) & ~F.col("is_null"), F.col("value"))).alias(f"c{k}") for k in range(len(columns))])
    return wide.toDF("row_idx", *columns)


def list_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """The folder's tables by name, the first ``limit`` of them if given: its Parquet files, and the parts of tables that are folders named as files.

    A table's parts share its ``file_basename``; ``part`` is null for a table of one file.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    steps = len(root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(root).toUri().getPath().rstrip("/").split("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Spark's paths can have another scheme than the folder's; the steps below it are the same.
    below = F.slice(F.split(F.regexp_replace("path", "^[^/]*:(//[^/]*)?", ""), "/"), steps + 1, 1 << 20)
    files = files.withColumn("__below", below).where(F.size("__below").isin(1, 2))
    files = files.withColumns({"file_basename": F.col("__below")[0], "part": F.try_element_at("__below", F.lit(2))}).drop("__below")
    files = files.where(F.col("file_basename").rlike(r"\A[^._].*\.parquet\z") & (F.col("part").isNull() | F.col("part").rlike(r"\A[^._]")))
    if limit is not None:
        names = files.select("file_basename").distinct().orderBy("file_basename").limit(limit)
        files = files.join(F.broadcast(names), "file_basename", "left_semi")
    return files


def _placed(files: DataFrame) -> DataFrame:
    """Files with the number of their first row in their table and the columns of the table's first part."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = [], []
            for content in batch.column(2).to_pylist():
                try:
                    file = pq.ParquetFile(pa.BufferReader(content))
                    rows.append(file.metadata.num_rows)
                    names.append(file.schema_arrow.names)
                except Exception:  # reported where its cells are read
                    rows.append(0)
                    names.append(None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["file_basename", "part", "rows", "names"])

    keys = ["file_basename", "part"]
    parts = files.where("part is not null").select(*keys, "content").mapInArrow(opened, "file_basename string, part string, rows long, names array<string>")
    table = Window.partitionBy("file_basename").orderBy("part")
    before = F.sum("rows").over(table.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("names", ignorenulls=True).over(table.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return files.join(parts.select(*keys, before.alias("row"), first.alias("names")), keys, "left")


def cells_of_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, read_errors) of files given as (file_basename, content), for stores that only Spark opens and for streams of files.

    ``part``, if there, tells the parts of one table apart. A file is decoded once to its end before its first cell, so a broken one has none.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, row, names in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                try:
                    check_part(pq.ParquetFile(pa.BufferReader(content)), names)
                    for _ in pq.ParquetFile(pa.BufferReader(content)).iter_batches(batch_size=4096):
                        pass
                    yield from cells_of_range(name, pq.ParquetFile(pa.BufferReader(content)), 0, 1 << 62, None, 4096, row or 0)
                except Exception as error:  # a file of any fault is reported and passed over
                    yield error_row(name, error)

    parted = "part" in files.columns
    placed = _placed(files) if parted else files.withColumns({"row": F.lit(0).cast("long"), "names": F.lit(None).cast("array<string>")})
    read = placed.select("file_basename", "content", "row", "names").mapInArrow(opened, f"{CELLS}, error string")
    cells, errors = read.where("error is null").drop("error"), _errors(read)
    # A fault in one part leaves out its table.
    return cells.join(F.broadcast(errors.select("file_basename")), "file_basename", "left_anti").select(*cells.columns) if parted else cells, errors


def _errors(read: DataFrame) -> DataFrame:
    """A row for each file that could not be read: file_basename, skip_reason, error."""
    return read.where("error is not null").groupBy("file_basename").agg(F.lit("read_error").alias("skip_reason"), F.min("error").alias("error"))


def opened_by_arrow(spark: SparkSession, folder: str) -> str | None:
    """The folder as pyarrow's file systems name it, or None if they cannot open it; Spark resolves mounts and links."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(path).toUri()
    found = uri.getPath() if uri.getScheme() in (None, "file") else uri.toString().replace("s3a://", "s3://", 1)
    try:
        pf.FileSystem.from_uri(found)
    except (pa.ArrowException, ValueError, OSError):
        return None
    return found


def scan(spark: SparkSession, folder: str, limit: int | None = None, tables: list[str] | None = None, columns: list[str] | None = None, **options: object) -> DataFrame:
    """Cells and error rows of a folder, by the data source ``cells``; names of tables and columns, and filters on them, prune what is read."""
    spark.dataSource.register(CellSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source has filters pushed to it
    asked = {"path": folder, "limit": limit, "tables": tables and json.dumps(tables), "columns": columns and json.dumps(columns), **options}
    return spark.read.format("cells").options(**{k: str(v) for k, v in asked.items() if v is not None}).load()


def read_corpus(
    spark: SparkSession, folder: str, limit: int | None = None, rules: Callable[[DataFrame], DataFrame] | None = None, tables: list[str] | None = None, columns: list[str] | None = None, **options: object,
) -> tuple[DataFrame, DataFrame]:
    """(cells, read_errors) of a folder of Parquet files; read_errors: file_basename, skip_reason, error.

    The folder is read once, and what ``rules`` make of its cells is staged for all that follow. A file that breaks anywhere has an
    error and no cells. Where only Spark can open the folder, whole files are read through it; it passes over files without bytes.
    """
    found = opened_by_arrow(spark, folder)
    if found is None:
        cells, errors = cells_of_files(list_files(spark, folder, limit))
        cells = cells if tables is None else cells.where(F.col("table_id").isin(tables))
        cells = cells if columns is None else cells.where(F.col("column").isin(columns))
        return staged(rules(cells) if rules else cells, "cells"), errors
    read = scan(spark, found, limit, tables, columns, **options)
    read = staged(rules(read) if rules else read, "cells")
    errors, cells = _errors(read), read.where("error is null").drop("error")
    if not errors.isEmpty():
        cells = cells.join(errors.select("file_basename"), "file_basename", "left_anti").select(*cells.columns)
    return cells, errors


def missing_path(error: Exception) -> bool:
    """Whether a read failed because there is nothing at its path."""
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table in the columns of ``schema``; absent columns are null, an absent path is an empty table."""
    wanted = T._parse_datatype_string(schema)
    try:
        found = spark.read.options(**options).format(fmt).load(path)
    except Exception as error:
        if not missing_path(error):
            raise
        return spark.createDataFrame([], wanted)
    return found.select(*[(F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])
