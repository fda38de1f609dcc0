"""The run ledger: all open shards in one job, each failed one tried once more by itself, resumed by what is recorded."""

import datetime as dt

from pyspark.sql import functions as F

from lacuna.operators import prep, profile, sampling
from lacuna.plans import config, ledger, runner
from lacuna.sources import corpus


def samples(spark):
    rows = [(f"t{t}", f"t{t}.parquet", r, c, f"c{c}", False, None if (r + c + t) % 3 == 0 else f"v{r % 7}", (r + c + t) % 3 == 0) for t in range(6) for r in range(30) for c in range(3)]
    masked = profile.with_mask(spark.createDataFrame(rows, corpus.CELLS)).persist()
    return sampling.build_manifest(masked, profile.eligibility(profile.column_profile(masked)).where("reason is null"), n=3).persist(), masked


def test_only_the_shard_at_fault_fails(spark, tmp_path, monkeypatch):
    manifest, masked = samples(spark)
    encoder, ablation, out, calls = config.Encoder("hash", "hashing", "hashing", 8), prep.ABLATIONS[0], str(tmp_path), []
    write = runner._write_shards

    def faulty(sampled, *rest):
        shards = sorted(r[0] for r in sampled.select("shard").distinct().collect())
        calls.append(shards)
        if 2 in shards:
            raise RuntimeError("broken model")
        write(sampled, *rest)

    monkeypatch.setattr(runner, "_write_shards", faulty)
    held = sorted(r[0] for r in manifest.select(F.pmod(F.xxhash64("table_id", "target_col_idx"), F.lit(4)).cast("int")).distinct().collect())
    assert 2 in held
    meta = runner.run_one(spark, manifest, masked, encoder, ablation, out, 4)
    assert calls[0] == held and len(calls) == 5  # one job for all, then one for each
    assert (meta["shards_done"], meta["shards_skipped"]) == (3, 1)
    entries = ledger.read(spark, f"{out}/ledger")
    assert {(r.shard, r.state, r.error) for r in entries.collect()} == {(0, "done", None), (1, "done", None), (2, "failed", "RuntimeError: broken model"), (3, "done", None)}
    runner.run_one(spark, manifest, masked, encoder, ablation, out, 4)
    assert len(calls) == 5  # failed ones are not tried again unless asked for
    monkeypatch.undo()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "hash").rglob("shard=0/*.parquet")}
    meta = runner.run_one(spark, manifest, masked, encoder, ablation, out, 4, retry_failed=True)
    assert meta["rows_total"] == manifest.count() and meta["shards_skipped"] == 0
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    found = spark.read.parquet(f"{out}/hash/{ablation.id}/pred_dataset.parquet")
    assert "shard" not in found.columns and found.select("sample_id").distinct().count() == manifest.count()


def test_last_entry_counts(spark, tmp_path):
    path, at = str(tmp_path / "book"), dt.datetime(2024, 1, 1)
    piece = {"encoder": "e", "ablation": "a", "manifest": "m", "shards": 3}
    assert ledger.read(spark, path).isEmpty()
    for minute, shard, state in ((0, 0, "failed"), (1, 0, "done"), (0, 1, "done"), (1, 1, "failed")):
        ledger.append(spark, path, [{**piece, "shard": shard, "state": state, "at": at + dt.timedelta(minutes=minute)}])
    wanted, entries = spark.range(3).select(F.col("id").cast("int").alias("shard")), ledger.read(spark, path)
    assert {r.shard for r in ledger.open_work(wanted, entries, ["shard"]).collect()} == {2}
    assert {r.shard for r in ledger.open_work(wanted, entries, ["shard"], retry_failed=True).collect()} == {1, 2}


def test_digest_is_of_the_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, "b"), (3, "1:a", "")]
    make = lambda rows: spark.createDataFrame(rows, "k int, x string, y string")
    digest = runner.manifest_digest(make(rows))
    assert digest == runner.manifest_digest(make(rows[::-1]).repartition(3).select("y", "k", "x"))
    changed = [rows[1:], [*rows, rows[0]], [(1, None, "a"), *rows[1:]], [*rows[:3], (3, "1:", "a")], [(2, "a", None), *rows[1:]]]
    assert len({digest, *(runner.manifest_digest(make(r)) for r in changed)}) == 6
