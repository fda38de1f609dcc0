"""Clean tables written one for each file, and occurrence lists with their order."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lacuna.operators import occurrences, sampling
from lacuna.plans import runner
from lacuna.sources.table_files import TableSink


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "in"
    made.mkdir()
    rows = 5000
    pq.write_table(pa.table({"rowId": range(rows), "some_Name": [None if k % 4 == 0 else f"A_b {k}" for k in range(rows)], "x": [k / 2 for k in range(rows)]}), made / "long.parquet")
    pq.write_table(pa.table({"only": ["p", None]}), made / "short.parquet")
    pq.write_table(pa.table({"a_b": [1], "a-b": [2]}), made / "twins.parquet")
    (made / "broken.parquet").write_bytes(b"no table")
    return made


def test_one_clean_table_for_each_file(spark, folder, tmp_path):
    out = tmp_path / "out"
    for _ in range(2):  # a second run takes the place of the first
        skipped = runner.clean_corpus(spark, str(folder), str(out))
        assert {tuple(r) for r in skipped.collect()} == {("twins.parquet", "colliding_headers"), ("broken.parquet", "read_error")}
        assert sorted(p.name for p in out.iterdir()) == ["long.parquet", "short.parquet"]
    assert pq.read_table(out / "short.parquet").to_pydict() == {"only": ["p", None]}
    long = pq.read_table(out / "long.parquet")
    assert long.column_names == ["row identifier", "some name", "x"] and long.num_rows == 5000
    assert long.slice(0, 3).to_pydict() == {"row identifier": ["0", "1", "2"], "some name": [None, "A b 1", "A b 2"], "x": ["0.0", "0.5", "1.0"]}
    assert long.column("row identifier").to_pylist() == [str(k) for k in range(5000)]


def written(spark, rows, path, at_once, partitions):
    spark.dataSource.register(TableSink)
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, column string, value string")
    dealt = cells.repartitionByRange(partitions, "table_id", "row_idx").sortWithinPartitions("table_id", "row_idx", "col_idx")
    dealt.write.format("table_files").mode("append").option("path", str(path)).option("cells_at_once", at_once).save()


@pytest.mark.parametrize("at_once", [1, 5, 10_000])
def test_rows_are_whole_however_they_are_cut(spark, tmp_path, at_once):
    """Chunks smaller than a row, tables over several tasks, several tables in one."""
    tables = {"a": 7, "b": 1, "c": 40, "d": 3}
    rows = [(t, r, k, f"{t}{k}", None if (r + k) % 5 == 0 else f"{t}-{r}-{k}") for t, width in tables.items() for r in range(23) for k in range(width)]
    written(spark, rows, tmp_path, at_once, 3)
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{t}.parquet" for t in tables]
    for t, width in tables.items():
        found = pq.read_table(tmp_path / f"{t}.parquet").to_pydict()
        assert found == {f"{t}{k}": [None if (r + k) % 5 == 0 else f"{t}-{r}-{k}" for r in range(23)] for k in range(width)}


@pytest.mark.parametrize("partitions", [1, 2, 3])
def test_a_failed_write_leaves_nothing(spark, tmp_path, partitions):
    (tmp_path / "a.parquet").write_bytes(b"as it was")
    with pytest.raises(Exception, match="differ in their columns"):
        written(spark, [("a", 0, 0, "x", "1"), ("a", 0, 1, "y", "2"), ("a", 1, 0, "x", "3"), ("a", 2, 0, "x", "4")], tmp_path, 1, partitions)
    assert [p.name for p in tmp_path.iterdir()] == ["a.parquet"] and (tmp_path / "a.parquet").read_bytes() == b"as it was"


def test_last_entry_of_a_list_counts(spark, tmp_path):
    """Over several files and lines, with quoted line feeds, entries of other columns, and lines that are none."""
    (tmp_path / "1.csv").write_text('kind,file,row_idx,column,original_value\nk,f,1,c,z\nk,f,1,c,"b, ""q""\nnext"\nk,f,2,c,only\nk,f,x,c,lost\nk,,3,c,lost\n')
    (tmp_path / "2.csv").write_text('file,row_idx,column,original_value,kind\n')
    (tmp_path / "2.csv").write_text('kind,file,row_idx,column,original_value\nk,f,2.0,c,a\nk,g,1,c,\n')
    entries, rejected = occurrences.read_occurrences(spark, str(tmp_path))
    assert {tuple(r) for r in occurrences.last_entries(entries).collect()} == {("f", "c", 1, 'b, "q"\nnext'), ("f", "c", 2, "a"), ("g", "c", 1, None)}
    assert rejected.count() == 2 and all("lost" in r.entry for r in rejected.collect())
    assert {tuple(r) for r in occurrences.last_entries(entries.drop("place")).collect()} >= {("f", "c", 1, "z"), ("f", "c", 2, "only")}


def test_absent_and_wrong_lists(spark, tmp_path):
    with pytest.warns(UserWarning, match="no occurrence list"):
        entries, rejected = occurrences.read_occurrences(spark, str(tmp_path / "none"))
    assert entries.isEmpty() and rejected.isEmpty() and occurrences.last_entries(entries).isEmpty()
    (tmp_path / "wrong.csv").write_text("file,column\nf,c\n")
    with pytest.raises(ValueError, match="row_idx"):
        occurrences.read_occurrences(spark, str(tmp_path / "wrong.csv"))


def test_a_list_labels_a_draw(spark, tmp_path):
    (tmp_path / "list.csv").write_text("file,column,row_idx,original_value\n" + "".join(f"t.parquet,c,{r},first\nt.parquet,c,{r},as listed {r}\n" for r in range(0, 20, 2)))
    masked = spark.createDataFrame([("t", "t.parquet", r, 0, "c", False, "unknown" if r % 2 == 0 else f"v{r % 5}", False, r % 2 == 0) for r in range(20)], "table_id string, file_basename string, row_idx long, col_idx int, column string, is_numeric boolean, value string, is_null boolean, missing boolean")
    eligible = masked.select("table_id", "file_basename", "col_idx", "column").distinct().withColumn("is_numeric", F.lit(False))
    made = sampling.build_manifest(masked, eligible, n=4, occurrences=occurrences.read_occurrences(spark, str(tmp_path / "list.csv"))[0]).collect()
    assert {r.special_token for r in made if r.y == 1} <= {f"as listed {r}" for r in range(20)} and sum(r.y for r in made) == 4 and len(made) == 8


def test_cells_are_put_in_normal_form_once(spark, folder, tmp_path, monkeypatch):
    """Neither the sampling of ranges nor the search for colliding headers puts cells in normal form again."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    monkeypatch.setattr(runner, "normalize", counted)
    runner.clean_corpus(spark, str(folder), str(tmp_path / "once"), tables=["long"])
    assert pq.read_table(tmp_path / "once" / "long.parquet").num_rows == 5000 and calls.value == 15_000 + 3
