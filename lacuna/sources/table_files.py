"""A Spark data source that writes cells as tables again, one for each source file, each with its own columns.

    cells.repartitionByRange("table_id", "row_idx").sortWithinPartitions("table_id", "row_idx", "col_idx")
        .write.format("table_files").mode("append").option("path", folder).save()

Tasks write the rows that they hold beside the target; when all have ended, the driver moves the files into place, and if one fails it removes them. A table whose rows
are all in one task is the file ``<table>.parquet``; a larger one is a folder of that name with its files in row order, which readers take as one
table. All columns are text. A task holds some thousand rows of one table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """(table, first row, path, columns) of each file that a task has written."""

    files: list[tuple[str, int, str, tuple[str, ...]]] = field(default_factory=list)


class _Table:
    """One table's rows in a task, written as they become whole."""

    def __init__(self, system: pf.FileSystem, table: str, path: str, cells_at_once: int):
        self.system, self.table, self.path, self.most = system, table, path, cells_at_once
        self.parts: list[pa.Table] = []
        self.held, self.width, self.first, self.writer = 0, 0, 0, None

    def add(self, cells: pa.Table) -> None:
        self.parts.append(cells)
        self.held += cells.num_rows
        if self.held > self.most:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        cells = pa.concat_tables(self.parts).combine_chunks()
        if not self.width:
            rows = cells.column("row_idx").to_numpy()
            self.width, self.first = int((rows == rows[0]).sum()), int(rows[0])
        # A row may be cut by the end of a batch; its cells wait, and the first row's number is known only when it is whole.
        n = cells.num_rows // self.width * self.width if last else (cells.num_rows - 1) // self.width * self.width
        now, self.parts = cells.slice(0, n), [cells.slice(n)]
        self.held = cells.num_rows - n
        if not n:
            return
        at = np.arange(0, n, self.width)
        if not np.array_equal(now.column("row_idx").to_numpy().reshape(-1, self.width), np.repeat(now.column("row_idx").take(at).to_numpy()[:, None], self.width, axis=1)):
            raise ValueError(f"rows of {self.table} differ in their columns")
        names = now.column("column").slice(0, self.width).to_pylist()
        made = pa.table([now.column("value").take(at + k).combine_chunks() for k in range(self.width)], names=names)
        if self.writer is None:
            self.stream = self.system.open_output_stream(self.path)
            self.writer, self.names = pq.ParquetWriter(self.stream, made.schema), tuple(names)
        self.writer.write_table(made)

    def close(self) -> tuple[str, int, str, tuple[str, ...]]:
        self._write(last=True)
        self.writer.close()
        self.stream.close()
        return self.table, self.first, self.path, self.names


class TableWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("cells_at_once", 200_000))
        self.attempt = f"_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = pf.FileSystem.from_uri(self.folder)
        own, out, table = f"{root}/{self.attempt}/{uuid.uuid4().hex}", Written(), None
        for batch in iterator:
            if not batch.num_rows:
                continue
            cells = pa.Table.from_batches([batch]).select(["table_id", "row_idx", "column", "value"])
            names = cells.column("table_id").combine_chunks()
            cuts = np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
                name = names[start].as_py()
                if table is None or table.table != name:
                    if table is not None:
                        out.files.append(table.close())
                    else:
                        system.create_dir(own)
                    table = _Table(system, name, f"{own}/{len(out.files)}.parquet", self.most)
                table.add(cells.slice(start, stop - start))
        if table is not None:
            out.files.append(table.close())
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, root = pf.FileSystem.from_uri(self.folder)
        tables: dict[str, list[tuple[int, str]]] = {}
        columns: dict[str, tuple[str, ...]] = {}
        for message in messages:
            for table, first, path, names in message.files if message else ():
                tables.setdefault(table, []).append((first, path))
                if columns.setdefault(table, names) != names:
                    self._clear(system, root)
                    raise ValueError(f"rows of {table} differ in their columns")
        for table, parts in tables.items():
            target = f"{root}/{table}.parquet"
            found = system.get_file_info(target).type
            if found == pf.FileType.Directory:
                system.delete_dir(target)
            elif found == pf.FileType.File:
                system.delete_file(target)
            if len(parts) == 1:
                system.move(parts[0][1], target)
                continue
            system.create_dir(target)
            for k, (_, path) in enumerate(sorted(parts)):
                system.move(path, f"{target}/part-{k:06d}.parquet")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*pf.FileSystem.from_uri(self.folder))

    def _clear(self, system: pf.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.attempt}").type == pf.FileType.Directory:
            system.delete_dir(f"{root}/{self.attempt}")


class TableSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "table_files"

    def writer(self, schema, overwrite: bool) -> TableWriter:
        return TableWriter(self.options)
