import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions.lexicon import PRIORITY_PATTERN
from lacuna.operators import prep, profile, sampling, tokens, vectors
from lacuna.plans import cli, config, embed, runner
from lacuna.sources import corpus
from lacuna.streaming import incremental


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three tables of different schemas, one broken file, and twins that are missing together."""
    path = tmp_path_factory.mktemp("corpus")
    n = 60
    pd.DataFrame({
        "Age": [None if i % 4 == 0 else i for i in range(n)], "age": ["unknown" if i % 3 == 0 else f"v{i % 7}" for i in range(n)], "twin a": [None if i % 5 == 0 else "p" for i in range(n)],
        "twinB": ["n/a" if i % 5 == 0 else f"q{i % 3}" for i in range(n)], "when": pd.to_datetime(["2020-01-01"] * n), "Unnamed: 0": [None if i % 2 else str(i) for i in range(n)],
    }).to_parquet(path / "a.parquet")
    pd.DataFrame({"x.y": [-999.0 if i % 6 == 0 else i + 0.5 for i in range(n)], "tags": [["t"]] * n, "flag": [None if i % 7 == 0 else bool(i % 2) for i in range(n)]}).to_parquet(path / "b.parquet")
    pd.DataFrame({"only": ["k"] * 4}).to_parquet(path / "c.parquet")
    (path / "d.parquet").write_bytes(b"not parquet")
    return str(path)


@pytest.fixture(scope="module")
def masked(spark, folder):
    return profile.with_mask(corpus.read_corpus(spark, folder)[0]).persist()


def build(masked, manifest=None, min_profile=5, **options):
    eligible = profile.eligibility(profile.column_profile(masked), min_n=min_profile).where("reason is null")
    return sampling.build_manifest(masked, eligible, profile.co_missing_lists(profile.co_missing_classes(masked)), manifest, **options)


def test_corpus_cells_and_read_errors(spark, folder, masked):
    _, errors = corpus.read_corpus(spark, folder)
    assert [(r.file_basename, r.skip_reason) for r in errors.collect()] == [("d.parquet", "read_error")]
    assert masked.count() == 60 * 6 + 60 * 3 + 4
    row = {r.column: (r.value, r.is_null, r.missing, r.is_numeric) for r in masked.where("row_idx = 0 and table_id in ('a', 'b')").collect()}
    assert row["Age"] == (None, True, True, True) and row["age"] == ("unknown", False, True, False) and row["x.y"] == ("-999.0", False, True, True)
    assert row["tags"] == ('["t"]', False, False, False) and row["when"][0] == "2020-01-01 00:00:00"
    assert corpus.list_files(spark, folder, 2).select("file_basename").count() == 2


def test_a_file_that_breaks_midway_has_no_cells(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [f"value {k} {k * 7919 % 10007}" for k in range(20_000)]}), tmp_path / "x.parquet", row_group_size=4096, use_dictionary=False)
    raw = bytearray((tmp_path / "x.parquet").read_bytes())
    at = pq.ParquetFile(tmp_path / "x.parquet").metadata.row_group(3).column(0).data_page_offset
    raw[at : at + 2000] = b"\xff" * 2000
    (tmp_path / "x.parquet").write_bytes(raw)
    pq.write_table(pa.table({"a": ["y"]}), tmp_path / "y.parquet")
    cells, errors = corpus.read_corpus(spark, str(tmp_path))
    assert [r.table_id for r in cells.collect()] == ["y"] and [r.file_basename for r in errors.collect()] == ["x.parquet"]


def test_profile_and_reasons(masked):
    rows = {(r.table_id, r.column): r for r in profile.eligibility(profile.column_profile(masked)).collect()}
    assert (rows["a", "Age"].n_missing, rows["a", "Age"].n_present, rows["a", "Age"].n_disguised) == (15, 45, 0)
    assert (rows["a", "age"].n_missing, rows["a", "age"].n_disguised, rows["a", "age"].n_unique_present) == (20, 20, 7)
    reasons = {k: r.reason for k, r in rows.items()}
    assert reasons["a", "Unnamed: 0"] == "internal_column" and reasons["a", "twin a"] == "constant" and reasons["c", "only"] == "lt_n_missing" and reasons["b", "flag"] is None


def test_co_missing(masked):
    pairs = {(r.table_id, r.column, r.other) for r in profile.co_missing_pairs(profile.co_missing_classes(masked)).collect()}
    assert pairs == {("a", "twin a", "twinB"), ("a", "twinB", "twin a")}


def test_one_and_many_columns_agree_and_share_no_rows(masked):
    one = {tuple(r) for r in build(masked).collect()}
    eligible = profile.eligibility(profile.column_profile(masked)).where("reason is null")
    found = sampling.candidates(masked, eligible, None, 42, 5)
    greedy = sampling.draw_many(found, 5, 5, 1).select("table_id", "col_idx", "row_idx").collect()
    assert {(r[3], r[6], r[7]) for r in one} == {tuple(r) for r in greedy}
    many = build(masked, columns_per_table=3).toPandas()
    assert not many.duplicated(["table_id", "row_idx"]).any()
    assert many.groupby(["table_id", "target_col"])["is_missing"].agg(["sum", "size"]).eq([5, 10]).all().all()
    assert sorted(many["sample_id"]) == list(range(len(many)))
    assert list(many.sort_values("sample_id")["is_missing"][:4]) == [True, False, True, False]


def test_runs_append_without_reuse(masked):
    first = build(masked, priority=PRIORITY_PATTERN).persist()
    assert first.where("table_id = 'a'").first()["column_type"] == "age"
    second = build(masked, first, first_id=sampling.next_sample_id(first)).persist()
    both = sampling.append(first, second).toPandas()
    assert not both.duplicated(["file_basename", "row_idx"]).any() and both["sample_id"].is_unique
    assert not set(map(tuple, first.select("file_basename", "target_col").collect())) & set(map(tuple, second.select("file_basename", "target_col").collect()))
    assert {r.run_index for r in second.collect()} == {1}
    assert build(masked).exceptAll(build(masked)).count() == 0


def test_caps(masked):
    assert build(masked, max_per_file_column=8).count() == 0
    labels = build(masked, columns_per_table=3, max_per_column_type=10).groupBy("column_type").count().toPandas()
    assert (labels["count"] <= 10).all()
    manifest = build(masked, columns_per_table=3)
    pruned = sampling.prune_to_caps(manifest, 5).groupBy("table_id", "target_col").agg(F.count_if("is_missing").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all((r.m, r.n) == (3, 5) for r in pruned)
    for bad in ({"n": 0}, {"n": 3, "min_n": 4}, {"seed": -1}, {"columns_per_table": 0}, {"max_per_column_type": 0}, {"max_per_file_column": 0}):
        with pytest.raises(ValueError):
            build(masked, **bad)


def test_label_cap_takes_columns_one_by_one(spark):
    """Against a pass over the columns in order; labels with prior rows, sizes that differ, and a label without room."""
    rng = random.Random(7)
    columns = [(f"t{k // 3}", f"t{k // 3}.parquet", k % 3, rng.choice("abc"), k % 3 + 1, rng.randint(1, 5)) for k in range(240)]
    prior = {"a": 7, "c": 60}
    drawn = spark.createDataFrame([(*c, row) for c in columns for row in range(2)], "table_id string, file_basename string, col_idx int, column_type string, column_rank int, drawn int, row_idx int")
    labels = spark.createDataFrame(list(prior.items()), "column_type string, n_label long")
    for cap, known in ((60, labels), (61, None), (1, labels)):
        total, wanted = dict(prior) if known is not None else {}, set()
        for table, file, col, label, _, size in sorted(columns, key=lambda c: (c[1], c[4])):
            if total.get(label, 0) + 2 * size <= cap:
                total[label] = total.get(label, 0) + 2 * size
                wanted.add((table, col))
        got = sampling.within_label_cap(drawn, known, cap).groupBy("table_id", "col_idx").count().collect()
        assert {(r.table_id, r.col_idx) for r in got} == wanted and all(r["count"] == 2 for r in got)


def test_run_numbers(spark):
    rows = spark.createDataFrame([("f", 0, "a", "a", 0), ("f", 1, "b", "b", 0), ("f", 2, "c", "c", 4), ("g", 0, "a", "a", 0)], "file_basename string, row_idx long, target_col string, column_type string, run_index int")
    runs = {rule: {r.file_basename: r.run_index for r in sampling.prior_state(rows, rule)["runs"].collect()} for rule in ("columns", "last")}
    assert runs == {"columns": {"f": 3, "g": 1}, "last": {"f": 5, "g": 1}}
    with pytest.raises(ValueError, match="run_rule"):
        sampling.prior_state(rows, "first")


def test_audit_names_columns_that_a_label_cap_dropped(spark, folder, tmp_path):
    assert cli.main(["sample", "--datasets", folder, "--out", str(tmp_path), "--columns", "2", "--max-per-column-type", "9", "--run-rule", "last"], spark) == 0
    reasons = {r.skip_reason for r in spark.read.parquet(f"{tmp_path}/summary").collect()}
    assert "max_per_column_type_reached" in reasons
    assert spark.read.parquet(f"{tmp_path}/sample_manifest.parquet").isEmpty()  # a column has 10 rows


def test_audit_reasons(masked):
    found = profile.eligibility(profile.column_profile(masked))
    able = found.where("reason is null")

    def reasons(prior, **options):
        new = sampling.build_manifest(masked, able, None, prior, **options)
        tried = sampling.candidates(masked, able, sampling.prior_state(prior) if prior is not None else None, 42, options.get("n", 5))
        return {(r.file, r.target_col): r.skip_reason for r in sampling.audit(found, new, tried, **options).collect()}

    first = reasons(None)
    assert first["c.parquet", "only"] == "lt_n_missing" and sorted(map(str, (v for k, v in first.items() if k[0] == "b.parquet"))) == ["None", "lt_n_missing", "not_selected_this_run"]
    capped = reasons(None, max_per_file_column=8)
    assert {capped["a.parquet", "age"], capped["b.parquet", "flag"]} == {"max_per_file_column_reached"}
    many = reasons(None, n=9)
    assert many["b.parquet", "flag"] in (None, "not_selected_this_run")
    short = reasons(None, n=11, min_n=11, max_per_file_column=100)
    assert short["b.parquet", "x.y"] == short["b.parquet", "flag"] == "insufficient_rows_after_exclusion"


def test_raw_labels_with_occurrences(spark, masked):
    rows = masked.where("column = 'age' and missing").select(F.col("file_basename").alias("file"), "column", "row_idx", F.lit("from list").alias("original_value"))
    eligible = profile.eligibility(profile.column_profile(masked)).where("column = 'age'")
    made = sampling.build_manifest(masked, eligible, label_mode="raw", occurrences=rows.where("row_idx % 2 = 0")).collect()
    assert {(r.special_token if r.y else None, r.row_idx % 2 == 0) for r in made if r.y} <= {("from list", True), ("unknown", False)} and all(r.special_token is None for r in made if not r.y)


def test_token_manifest_and_occurrences(masked):
    rows = tokens.token_manifest(masked).toPandas()
    assert rows.groupby("target_col")["y"].agg(["sum", "size"]).to_dict("index") == {"age": {"sum": 20, "size": 40}, "twinB": {"sum": 12, "size": 24}}
    marks = tokens.occurrence_summary(tokens.occurrences(masked)).collect()
    assert {(r.normalized_value, r.kind, r.n_occurrences) for r in marks} == {("unknown", "literal", 20), ("n/a", "literal", 12), ("-999.0", "numeric_sentinel", 10)}


def test_sentences_and_tables(spark):
    cells = spark.createDataFrame(
        [("t", "t.parquet", 0, 0, "firstName", False, "AnnB", False), ("t", "t.parquet", 0, 1, "avg_bp", True, "42.0", False), ("t", "t.parquet", 0, 2, "Sex", False, "unknown", False), ("t", "t.parquet", 0, 3, "age", True, None, True)],
        corpus.CELLS,
    )
    manifest = spark.createDataFrame([(7, "t", 0, "age", "age", 3, 1, "nan", None, '["Sex"]')], "sample_id long, table_id string, row_idx long, column_type string, target_col string, target_col_idx int, y int, missing_kind string, special_token string, co_missing_columns string")
    sampled = prep.sampled_cells(manifest, profile.with_mask(cells))
    got = {a.id: prep.sentences(sampled, a).first()["sentence"] for a in prep.ABLATIONS}
    full = "first name: AnnB, average blood pressure: 42, sex: [EMPTY], age: [?]"
    assert got == {
        "default": full, "meanpool_target": full, "without_header": "AnnB, 42, [EMPTY], [?]", "without_target": full.removesuffix(", age: [?]"),
        "only_target": "c0: AnnB, c1: 42, c2: [EMPTY], age: [?]", "co_missing_drop": full.replace("sex: [EMPTY], ", ""),
    }
    table = prep.tables(sampled, prep.ABLATIONS[5]).first()
    assert [tuple(c) for c in table["cells"]] == [("first name", "ann B"), ("average blood pressure", "42.0"), ("age", "[?]")] and table["target_position"] == 2
    assert prep.tables(sampled, prep.ABLATIONS[2]).first()["target_position"] is None
    with pytest.raises(ValueError):
        prep.Ablation("x", header="none")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [list(r[0]) for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert vectors.embedding_names(1024)[-1] == "emb_1023" and vectors.embedding_names(64)[1] == "emb_001"
    found = spark.range(1).select(vectors.resolve_positions([-1, 0], F.lit(4)), vectors.resolve_positions(None, F.lit(2)), vectors.resolve_positions(None, F.lit(0))).first()
    assert [list(v) for v in found] == [[3, 0], [0, 1], []]
    for wrong in (4, -5):
        with pytest.raises(Exception, match="positions"):
            spark.range(1).select(vectors.resolve_positions([wrong], F.lit(4))).collect()


def test_half_precision_equals_numpy(spark):
    """Of all sizes: normal and subnormal numbers, ties, the ends of the range, and what is no number."""
    rng = np.random.default_rng(4)
    ties = [float(np.float16(x)) + float(np.spacing(np.float16(x))) / 2 for x in (0.1, 1, 1.0009765625, 1023, 6e-8, 3e-5)]
    values = [0.0, 1.0, 65504.0, 65519.99, 65520.0, 1e9, 2**-24, 2**-25, 2**-14, 1e-9, float("inf"), float("nan"), *ties, *(10 ** rng.uniform(-9, 5, 3000)).tolist()]
    values += [-v for v in values]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select("x", vectors.half_precision(F.col("x")).alias("h")).collect()
    assert [r.h for r in rows if r.x is None] == [None]
    with np.errstate(over="ignore"):
        for r in rows:
            if r.x is not None:
                assert np.array_equal(np.float64(r.h), np.float64(np.float16(r.x)), equal_nan=True), r


def test_attentions_equal_numpy(spark):
    rng = np.random.default_rng(5)
    tensors = [(k, (rng.random((2, 3, 5, 5)) * (k % 3)).tolist()) for k in range(6)]
    df = spark.createDataFrame([*tensors, (6, None), (7, [])], "sample_id long, attention array<array<array<array<double>>>>")
    for layers, heads, renormalise in (([-1], None, True), (None, [2, 0], False), (None, None, True)):
        if layers:
            df = df.where("sample_id < 7")  # a tensor without layers has no last one
        wanted = {}
        for k, tensor in tensors:
            array = np.array(tensor)
            for a in range(2) if layers is None else [1]:
                for h in range(3) if heads is None else heads:
                    w = array[a, h] / np.maximum(array[a, h].sum(axis=-1, keepdims=True), 1e-6) if renormalise else array[a, h]
                    wanted[k, a, h] = w.astype(np.float16).astype(float).tolist()
        assert {(r.sample_id, r.layer, r.head): r.weights for r in embed.attentions(df, layers, heads, renormalise).collect()} == wanted


def test_run_resumes_and_guards(spark, masked, tmp_path):
    manifest = build(masked, columns_per_table=2).persist()
    spec = config.Config((config.Encoder("hash", "hashing", "hashing", 8),))
    out = str(tmp_path)
    metas = runner.run_all(spark, manifest, masked, spec, out, ablations=["default", "meanpool_target"], shards=2)
    assert [m["rows_total"] for m in metas] == [manifest.count()] * 2
    before = os.stat(f"{out}/hash/default/shards/shard=0").st_mtime_ns
    assert runner.run_one(spark, manifest, masked, spec.encoders[0], spec.ablations[0], out, 2)["rows_total"] == manifest.count()
    assert os.stat(f"{out}/hash/default/shards/shard=0").st_mtime_ns == before
    with pytest.raises(ValueError):
        runner.run_one(spark, manifest.limit(3), masked, spec.encoders[0], spec.ablations[0], out, 2)
    tables = config.Encoder("tab", "hashing", "hashing_table", 400)
    for ablation in (prep.ABLATIONS[2], prep.ABLATIONS[4]):
        assert runner.run_one(spark, manifest, masked, tables, ablation, out)["rows_total"] == manifest.count()
    broken = config.Encoder("bad", "none", "none", 8)
    assert runner.run_one(spark, manifest, masked, broken, spec.ablations[0], out)["shards_skipped"] == 1
    with pytest.raises(ValueError):
        spec.selected(["nope"])


def test_a_run_reads_the_corpus_once_and_misses_no_sample(spark, masked, tmp_path):
    manifest = build(masked, columns_per_table=2).persist()
    encoder, (default, meanpool) = config.Encoder("hash", "hashing", "hashing", 8), (prep.ABLATIONS[0], prep.ABLATIONS[4])
    runner.run_one(spark, manifest, masked, encoder, default, str(tmp_path), 2)
    gone = masked.where("false")  # what follows does not need the corpus any more
    assert runner.run_one(spark, manifest, gone, encoder, meanpool, str(tmp_path), 2)["rows_total"] == manifest.count()
    with pytest.raises(ValueError, match="no row in the source"):
        runner.run_one(spark, manifest, gone, encoder, default, str(tmp_path / "other"), 2)
    first = runner.first_groups(manifest, 1)
    assert first.select("table_id", "target_col_idx").distinct().count() == 1
    assert runner.run_one(spark, manifest, masked, encoder, default, str(tmp_path / "few"), limit_groups=1)["rows_total"] == first.count()


def test_a_table_is_never_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    runner.replace_table(spark, spark.range(3), path)
    rename = runner._rename
    monkeypatch.setattr(runner, "_rename", lambda fs, a, b: (_ for _ in ()).throw(OSError("stopped")) if a.toString().endswith(".tmp") else rename(fs, a, b))
    with pytest.raises(OSError):
        runner.replace_table(spark, spark.range(9), path)
    monkeypatch.undo()
    assert not os.path.exists(path) and runner.recover(spark, path) and spark.read.parquet(path).count() == 3
    runner.replace_table(spark, spark.range(9), path)
    assert spark.read.parquet(path).count() == 9 and not os.path.exists(f"{path}.old")
    for k in (1, 2):
        runner.write_json(spark, f"{path}.json", {"k": k})
        assert runner.read_json(spark, f"{path}.json") == {"k": k}
    assert not runner.recover(spark, str(tmp_path / "none"))


def test_command_line(spark, folder, tmp_path):
    out = str(tmp_path / "s")
    for _ in range(2):
        cli.main(["sample", "--datasets", folder, "--out", out, "--n", "3", "--occurrences"], spark)
    manifest = spark.read.parquet(f"{out}/sample_manifest.parquet").toPandas()
    assert len(manifest) == 24 and manifest["sample_id"].is_unique and spark.read.parquet(f"{out}/read_errors").count() == 2
    cli.main(["prune", "--out", out, "--max-per-file-column", "4"], spark)
    assert spark.read.parquet(f"{out}/sample_manifest.parquet").count() == 16
    cli.main(["tokens", "--datasets", folder, "--out", out], spark)
    (tmp_path / "c.yaml").write_text("encoders:\n- {id: h, name: hashing, family: hashing, hidden_size: 8}\nablations:\n- {id: default}\n")
    cli.main(["run", "--datasets", folder, "--manifest", f"{out}/sample_manifest.parquet", "--config", str(tmp_path / "c.yaml"), "--out", f"{out}/p"], spark)
    assert spark.read.parquet(f"{out}/p/h/default/pred_dataset.parquet").count() == 16
    cli.main(["clean", "--datasets", folder, "--out", f"{out}/clean"], spark)
    assert {f[: -len(".parquet")] for f in os.listdir(f"{out}/clean") if f.endswith(".parquet")} == {"b", "c"}
    assert spark.read.parquet(f"{out}/clean/b.parquet").columns


def test_stream_samples_each_file_once(spark, folder, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a.parquet", "b.parquet"):
        (source / name).write_bytes(open(f"{folder}/{name}", "rb").read())
        incremental.sample_new_files(spark, str(source), out, str(tmp_path / "ck"), n=3).awaitTermination()
    got = spark.read.parquet(out).toPandas()
    assert got.groupby(["batch", "table_id"]).size().to_dict() == {(0, "a"): 6, (1, "b"): 6} and sorted(got["sample_id"]) == list(range(12))


def test_a_draw_reads_only_columns_that_it_can_come_to(spark):
    """Columns behind those sure to be drawn change nothing and are left out; where prior rows, few cells or a cap make a draw unsure, those behind stay."""
    rows = [(f"t{t}", f"t{t}.parquet", i, c, f"c{c}", False, None if (i * 7 + c * 3) % (c + 2 + t) == 0 else f"v{i % 5}") for t in range(3) for c in range(6) for i in range(60)]
    cells = spark.createDataFrame(rows, "table_id string, file_basename string, row_idx long, col_idx int, column string, is_numeric boolean, value string")
    masked = profile.with_mask(cells.withColumn("is_null", F.col("value").isNull())).persist()
    eligible = profile.eligibility(profile.column_profile(masked), min_n=2).where("reason is null").persist()
    first = sampling.build_manifest(masked, eligible, n=4).persist()
    kept = {}
    for name, n, low, columns, cap, manifest in (("plain", 5, 5, 1, 20, None), ("many", 3, 2, 3, 20, None), ("prior", 8, 2, 2, 20, first), ("few", 25, 3, 1, 80, None), ("cap", 5, 5, 1, 9, None), ("again", 5, 2, 1, 12, first)):
        prior = sampling.prior_state(manifest) if manifest is not None else None
        keep, skip = n * (2 * columns - 1), name != "again"
        every = sampling.candidates(masked, eligible, prior, 42, keep, skip)
        some = sampling.candidates(masked, eligible, prior, 42, keep, skip, None, lambda ranked: sampling.reached(ranked, n, columns, cap))
        keys = ["table_id", "col_idx", "row_idx", "missing", "order", "drawn"]
        drawn = [sorted(map(tuple, sampling.draw(found, n, low, columns, cap).select(*keys).collect())) for found in (every, some)]
        assert drawn[0] == drawn[1], name
        kept[name] = [found.select("table_id", "col_idx").distinct().count() for found in (every, some)]
    assert kept["plain"] == [15, 3] and kept["many"][1] < 15 and kept["cap"] == [15, 15] and kept["few"][1] > 3
