"""The data source of cells: ranges, pruning, broken files."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lacuna.operators.profile import with_mask
from lacuna.sources import corpus
from lacuna.sources.cell_source import CellReader, cells_of_range


@pytest.fixture
def folder(tmp_path):
    rows = 30_000
    a = pa.table({"id": range(rows), "text": [f"word {k} {'x' * (k % 50)}" for k in range(rows)], "Id": [None if k % 3 else k / 2 for k in range(rows)]})
    pq.write_table(a, tmp_path / "a.parquet", row_group_size=4000, compression="none", use_dictionary=False)
    pq.write_table(pa.table({"text": ["p", None], "list": [[1, 2], None], "yes": [True, False]}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"none": pa.array([], pa.string())}), tmp_path / "c.parquet")
    (tmp_path / "d.parquet").write_bytes(b"")
    (tmp_path / "e.parquet").write_bytes(b"PAR1 no footer at all")
    (tmp_path / "note.txt").write_text("not a table")
    (tmp_path / "sub").mkdir()
    pq.write_table(pa.table({"x": [1]}), tmp_path / "sub" / "f.parquet")
    return tmp_path


def test_every_cell_once_however_files_are_split(spark, folder):
    """Ranges far smaller than row groups, and one range a file, give the same cells; row numbers go on over row groups."""
    for split in (1000, 1 << 30):
        cells, errors = corpus.read_corpus(spark, str(folder), split_bytes=split, batch_rows=700)
        assert {r.file_basename for r in errors.collect()} == {"d.parquet", "e.parquet"} and errors.count() == 2
        sums = cells.groupBy("table_id", "column", "col_idx").agg(F.count("*").alias("n"), F.count_distinct("row_idx").alias("rows"), F.count_if("is_null").alias("nulls"), F.max("row_idx").alias("last"))
        assert {tuple(r) for r in sums.collect()} == {("a", "id", 0, 30000, 30000, 0, 29999), ("a", "text", 1, 30000, 30000, 0, 29999), ("a", "Id", 2, 30000, 30000, 20000, 29999), ("b", "text", 0, 2, 2, 1, 1), ("b", "list", 1, 2, 2, 1, 1), ("b", "yes", 2, 2, 2, 0, 1)}
        assert cells.where("table_id = 'a' and column = 'text' and value <> concat('word ', row_idx, ' ', repeat('x', cast(row_idx % 50 as int)))").isEmpty()
    assert {(r.column, r.value) for r in cells.where("table_id = 'b' and row_idx = 0").collect()} == {("text", "p"), ("list", "[1,2]"), ("yes", "True")}
    assert cells.where("column = 'id'").select("is_numeric").distinct().collect()[0][0] is True


def test_limit_takes_first_names(spark, folder):
    cells, errors = corpus.read_corpus(spark, str(folder), limit=2)
    assert {r[0] for r in cells.select("table_id").distinct().collect()} == {"a", "b"} and errors.isEmpty()


def test_a_file_that_breaks_midway_has_no_cells(spark, folder):
    """Ranges before the fault are read, but the file's cells are dropped, and it is reported once."""
    raw = bytearray((folder / "a.parquet").read_bytes())
    group = pq.ParquetFile(folder / "a.parquet").metadata.row_group(5).column(1)
    raw[group.data_page_offset : group.data_page_offset + 30] = b"\xff" * 30
    (folder / "a.parquet").write_bytes(raw)
    cells, errors = corpus.read_corpus(spark, str(folder), rules=with_mask, split_bytes=100_000)
    assert {r.file_basename for r in errors.collect()} == {"a.parquet", "d.parquet", "e.parquet"} and errors.count() == 3
    assert {r[0] for r in cells.select("table_id").distinct().collect()} == {"b"} and "missing" in cells.columns
    # The broken column's bytes are not read where other columns are asked for.
    cells, errors = corpus.read_corpus(spark, str(folder), columns=["id"], tables=["a"])
    assert cells.count() == 30_000 and errors.isEmpty()
    pushed = corpus.scan(spark, str(folder)).where("table_id = 'a' and column in ('id', 'Id')")
    assert pushed.count() == 60_000


def test_bytes_read_follow_the_columns(folder):
    """Counted at the file: two small columns cost their chunks and the footer, not the text."""
    path = folder / "a.parquet"
    read = 0

    class Counted(pa.PythonFile):
        pass

    class File:
        def __init__(self):
            self.f, self.closed = open(path, "rb"), False

        def read(self, n=-1):
            nonlocal read
            out = self.f.read(n)
            read += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

    list(cells_of_range("a.parquet", pq.ParquetFile(Counted(File(), mode="r")), 0, 1 << 62, frozenset(["id", "Id"]), 4096))
    meta = pq.ParquetFile(path).metadata
    chunks = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in (0, 2))
    assert chunks <= read < chunks + 200_000 < path.stat().st_size / 2


def test_partitions_follow_ranges_and_pushed_tables(folder):
    reader = CellReader({"path": str(folder), "split_bytes": "100000"})
    size = (folder / "a.parquet").stat().st_size
    assert len([p for p in reader.partitions() if p.name == "a.parquet"]) == -(-size // 100_000)
    assert {p.name for p in CellReader({"path": str(folder), "tables": json.dumps(["b"])}).partitions()} == {"b.parquet"}


def test_only_spark_can_open(spark, folder, monkeypatch):
    """Without a file system of pyarrow, whole files go through Spark, with the same cells and errors."""
    expected = {tuple(r) for r in corpus.read_corpus(spark, str(folder))[0].where("table_id = 'b' or row_idx < 5").collect()}
    monkeypatch.setattr(corpus, "opened_by_arrow", lambda spark, folder: None)
    cells, errors = corpus.read_corpus(spark, str(folder))
    assert {tuple(r) for r in cells.where("table_id = 'b' or row_idx < 5").collect()} == expected
    assert {r.file_basename for r in errors.collect()} == {"e.parquet"}  # Spark passes over files without bytes
    assert {r[0] for r in corpus.read_corpus(spark, str(folder), columns=["Id"], tables=["a", "b"])[0].select("column").distinct().collect()} == {"Id"}


def test_floats_have_the_fewest_digits(spark):
    """As Python shows them; of more than 16 digits, and of the least numbers, the same number is enough."""
    rng = random.Random(3)
    values = [0.0, -0.0, 1e-4, 9.999e-5, 1e16, 9999999.5, 1e7, 1e23, 2e-3, 2.505e21, -1.17e22, 5e-324, 1.7976931348623157e308, float("inf"), -float("inf")]
    values += [float(f"{rng.randrange(1, 10 ** rng.randrange(1, 16))}e{rng.randrange(-30, 30)}") for _ in range(3000)] + [rng.uniform(-1e4, 1e4) for _ in range(1000)]
    for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", corpus.float_text(F.col("x")).alias("shown")).collect():
        assert float(r.shown) == r.x and (r.shown == repr(r.x) or 0 < abs(r.x) < 1e-300 or len(repr(r.x).split("e")[0].strip("-")) > 17), r


@pytest.mark.parametrize("by_arrow", [True, False])
def test_a_folder_of_parts_is_one_table(spark, tmp_path, monkeypatch, by_arrow):
    """Rows go on over the parts in the order of their names; a folder whose parts cannot make one table is reported and has no cells."""
    if not by_arrow:
        monkeypatch.setattr(corpus, "opened_by_arrow", lambda spark, folder: None)
    for name in ("t", "odd", "broken"):
        (tmp_path / f"{name}.parquet").mkdir()
    for k in range(12):
        pq.write_table(pa.table({"a": range(k * 10, k * 10 + 10), "b": [None] * 10}, pa.schema([("a", pa.int64()), ("b", pa.string())])), tmp_path / "t.parquet" / f"part-{k:04d}.parquet", row_group_size=4)
    (tmp_path / "t.parquet" / "_SUCCESS").write_bytes(b"")
    pq.write_table(pa.table({"x": [1]}), tmp_path / "odd.parquet" / "0.parquet")
    pq.write_table(pa.table({"y": [1]}), tmp_path / "odd.parquet" / "1.parquet")
    pq.write_table(pa.table({"x": [1]}), tmp_path / "broken.parquet" / "0.parquet")
    (tmp_path / "broken.parquet" / "1.parquet").write_bytes(b"no table")
    pq.write_table(pa.table({"x": [1]}), tmp_path / "u.parquet")
    cells, errors = corpus.read_corpus(spark, str(tmp_path))
    assert {(r.file_basename, r.skip_reason) for r in errors.collect()} == {("odd.parquet", "read_error"), ("broken.parquet", "read_error")}
    found = cells.where("table_id = 't'")
    assert found.count() == 240 and found.where("column = 'a' and value <> cast(row_idx as string)").isEmpty() and found.select("row_idx").distinct().count() == 120
    assert {r[0] for r in cells.select("table_id").distinct().collect()} == {"t", "u"}
    first, _ = corpus.read_corpus(spark, str(tmp_path), limit=3)
    assert {r[0] for r in first.select("table_id").distinct().collect()} == {"t"}
