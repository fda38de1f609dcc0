"""A Spark data source that reads a folder of heterogeneous Parquet files as cells.

    spark.dataSource.register(CellSource)
    spark.read.format("cells").option("path", folder).load()

A file is dealt out by ranges of bytes, as Spark's own reader does, and a task reads the footers of its files and those row groups whose middle lies in its range: large files
spread over tasks, nothing is read on the driver but the list of names, and a task holds one batch of rows. Filters on ``table_id`` leave out files, filters on
``column`` leave out column chunks, so the bytes read are those of the columns asked for. A range that cannot be read to its
end yields a row with ``error`` instead of the rest of its cells.

A table is a file of the folder, or a folder in it that is named as one and holds its parts: their rows follow one another in the order of the parts' names.
Only parts' footers are read on the driver, as a part's first row is the number of rows before it.

Options: ``path``, a folder that pyarrow's file systems can open; ``limit``, the first files by name; ``tables`` and ``columns``, JSON arrays of names to be
read; ``split_bytes`` and ``batch_rows``, the sizes of ranges and batches.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

CELLS = "table_id string, file_basename string, row_idx long, col_idx int, column string, is_numeric boolean, value string, is_null boolean"
_NAMES = [*(x.split()[0] for x in CELLS.split(", ")), "error"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
_SUFFIX = ".parquet"


# ------------------------------------------------------------------------------------ cells of a batch


def cell_text(value: object) -> str | None:
    """The text form of a Python value, as it is shown; None for null and NaN."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    return str(value)


def _texts(column: pa.Array) -> pa.Array:
    if pa.types.is_string(column.type):
        return column
    if pa.types.is_integer(column.type):
        return pc.cast(column, pa.string())
    values = column.to_pylist()
    if width := {pa.float16(): np.float16, pa.float32(): np.float32}.get(column.type):  # shown by the digits of their own width
        values = [None if v is None else float(np.format_float_scientific(width(v))) for v in values]
    return pa.array([cell_text(v) for v in values], pa.string())


def cells_of_batch(name: str, batch: pa.RecordBatch, positions: list[int], start: int) -> Iterator[pa.RecordBatch]:
    """The cells of each column of a file's batch; ``positions`` are the columns' places in the file, ``start`` its first row's."""
    n = batch.num_rows
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
    for k, column, field in zip(positions, batch.columns, batch.schema, strict=True):
        numeric = pa.types.is_integer(field.type) or pa.types.is_floating(field.type) or pa.types.is_boolean(field.type)
        value = _texts(column)
        values = [name.removesuffix(_SUFFIX), name, None, k, field.name, numeric, None, None, None]
        arrays = [same(v, kind) for v, kind in zip(values, _KINDS, strict=True)]
        arrays[2], arrays[6], arrays[7] = pa.array(np.arange(start, start + n)), value, value.is_null()
        yield pa.record_batch(arrays, names=_NAMES)


def error_row(name: str, error: Exception) -> pa.RecordBatch:
    values = [None, name, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:500]]
    return pa.record_batch([pa.array([v], kind) for v, kind in zip(values, _KINDS, strict=True)], names=_NAMES)


def _middle(group: pq.RowGroupMetaData) -> int:
    first = group.column(0)
    offsets = [x for x in (first.dictionary_page_offset, first.data_page_offset) if x is not None]
    return min(offsets) + sum(group.column(k).total_compressed_size for k in range(group.num_columns)) // 2


def cells_of_range(name: str, file: pq.ParquetFile, start: int, stop: int, columns: frozenset[str] | None, batch_rows: int, row: int = 0) -> Iterator[pa.RecordBatch]:
    """The cells of the row groups whose middle lies in a range of a file's bytes; ``row`` is the number of the file's first row."""
    names = file.schema_arrow.names
    positions = [k for k, c in enumerate(names) if columns is None or c in columns]
    # Columns are read by name; where names repeat, a name stands for all columns that have it.
    wanted = None if columns is None else sorted({names[k] for k in positions})
    for k in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(k)
        if positions and start <= _middle(group) < stop:
            at = row
            for batch in file.iter_batches(batch_size=batch_rows, row_groups=[k], columns=wanted):
                yield from cells_of_batch(name, batch, positions, at)
                at += batch.num_rows
        row += group.num_rows


# ------------------------------------------------------------------------------------ data source


@dataclass
class FileRange(InputPartition):
    path: str
    name: str
    start: int
    stop: int
    row: int = 0
    names: tuple[str, ...] | None = None  # the columns of the table's first part


def check_part(file: pq.ParquetFile, names: Iterable[str] | None) -> None:
    """Parts make one table only if they have the same columns."""
    if names is not None and tuple(file.schema_arrow.names) != tuple(names):
        raise ValueError("the parts of a table differ in their columns")


def is_table(name: str) -> bool:
    return name.endswith(_SUFFIX) and name[0] not in "._"


def is_part(name: str) -> bool:
    return name[0] not in "._"


class CellReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.split_bytes, self.batch_rows = int(options.get("split_bytes", 128 << 20)), int(options.get("batch_rows", 4096))
        self.names = {field: frozenset(json.loads(options[key])) if options.get(key) else None for field, key in (("table_id", "tables"), ("column", "columns"))}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names asked for by equality; all filters stay with Spark too, which costs little beside reading."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.names:
                asked = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                known = self.names[f.attribute[0]]
                self.names[f.attribute[0]] = asked if known is None else asked & known
            yield f

    def partitions(self) -> list[FileRange]:
        system, root = pf.FileSystem.from_uri(self.folder)
        files = sorted((f for f in system.get_file_info(pf.FileSelector(root)) if f.type in (pf.FileType.File, pf.FileType.Directory) and is_table(f.base_name)), key=lambda f: f.base_name)
        tables = self.names["table_id"]
        found = []
        for f in files[: self.limit]:
            if tables is None or f.base_name.removesuffix(_SUFFIX) in tables:
                found += self._ranges(f, f.base_name) if f.type == pf.FileType.File else self._parts(system, f)
        # Spark asks for at least one partition.
        return found or [FileRange("", "", 0, 0)]

    def _ranges(self, f: pf.FileInfo, name: str, row: int = 0, names: tuple[str, ...] | None = None) -> list[FileRange]:
        # The last range has no end, and an empty file has one range, so that it is reported.
        starts = range(0, max(f.size or 0, 1), self.split_bytes)
        return [FileRange(f.path, name, s, s + self.split_bytes if s + self.split_bytes < (f.size or 0) else 1 << 62, row, names) for s in starts]

    def _parts(self, system: pf.FileSystem, folder: pf.FileInfo) -> list[FileRange]:
        """The ranges of a table's parts; a folder without parts has one range, so that it is reported."""
        parts = sorted((f for f in system.get_file_info(pf.FileSelector(folder.path)) if f.type == pf.FileType.File and is_part(f.base_name)), key=lambda f: f.base_name)

        def footer(f: pf.FileInfo) -> tuple[int, tuple[str, ...] | None]:
            try:
                with system.open_input_file(f.path) as opened:
                    file = pq.ParquetFile(opened)
                    return file.metadata.num_rows, tuple(file.schema_arrow.names)
            except Exception:  # the task that reads the part reports its fault, and the table has no cells
                return 0, None

        with ThreadPoolExecutor(16) as pool:
            footers = list(pool.map(footer, parts))
        names = next((n for _, n in footers if n is not None), None)
        found, row = [], 0
        for f, (rows, _) in zip(parts, footers, strict=True):
            found += self._ranges(f, folder.base_name, row, names)
            row += rows
        return found or [FileRange(folder.path, folder.base_name, 0, 1 << 62)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        try:
            system, _ = pf.FileSystem.from_uri(self.folder)
            with system.open_input_file(partition.path) as opened:
                file = pq.ParquetFile(opened)
                check_part(file, partition.names)
                yield from cells_of_range(partition.name, file, partition.start, partition.stop, self.names["column"], self.batch_rows, partition.row)
        except Exception as error:  # a file of any fault is reported and passed over
            yield error_row(partition.name, error)


class CellSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return f"{CELLS}, error string"

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)
