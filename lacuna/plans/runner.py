"""The resumable run: from a sample manifest to prediction datasets, by encoder and ablation.

Groups (table and target column) are dealt to shards by a hash of their name. A run's open shards are one Spark job, and each
shard's output folder is put in place as a whole. A ledger records shards that are complete, which are not run again, and those that failed, which are
tried again only if asked for. A digest of the manifest guards a resumed run against another manifest.
The corpus is read once for a manifest: the sampled rows' cells are written by shard, and all encoders, ablations and shards
start from them. All files go through the file system that Spark is configured with.
"""

from __future__ import annotations

import datetime as dt
import json
import platform
import shutil
import subprocess
import uuid
from collections.abc import Sequence
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.text import normalize, safe_name
from lacuna.operators import prep, vectors
from lacuna.plans import embed, ledger
from lacuna.plans.config import Config, Encoder
from lacuna.sources.corpus import opened_by_arrow, read_corpus
from lacuna.sources.staging import staged
from lacuna.sources.table_files import TableSink


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = hadoop.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found, hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, found, _ = _file_system(spark, path)
    return fs.exists(found)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write beside the target and rename over it in one step, so that a reader sees the old file or the new one."""
    fs, target, hadoop = _file_system(spark, path)
    part = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value, indent=2).encode()))
    out.close()
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(part), fs.makeQualified(target), options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a table whole and put it in the place of ``path``.

    A folder cannot be renamed over another one, so the old table is first moved to ``<path>.old`` and removed at the end.
    Whenever the work stops between the two steps, the old table is whole under that name, and ``recover`` moves it back.
    """
    fs, target, hadoop = _file_system(spark, path)
    old, part = hadoop.Path(f"{path}.old"), f"{path}.{uuid.uuid4().hex}.tmp"
    recover(spark, path)
    df.write.parquet(part)
    if fs.exists(target):
        fs.delete(old, True)
        _rename(fs, target, old)
    _rename(fs, hadoop.Path(part), target)
    fs.delete(old, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source.toString()} could not be renamed to {target.toString()}")


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``; one that an interrupted ``replace_table`` has moved away is moved back."""
    fs, target, hadoop = _file_system(spark, path)
    old = hadoop.Path(f"{path}.old")
    if not fs.exists(target) and fs.exists(old):
        _rename(fs, old, target)
    return fs.exists(target)


def multiset_digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """An order-free digest of rows, for each group of ``by``: their number, and the sums of both halves of their md5, modulo 2^64.

    A row's text is its values by column name, each with its length in characters, null as a dash. Sums can be merged from parts, count repeated rows, and are the same in any engine.
    """
    shown = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(f"`{n}`").cast("string") for n in sorted(set(df.columns) - set(by)))]
    row = F.md5(F.concat(F.lit(""), *shown))
    half = lambda start: F.pmod(F.sum(F.conv(F.substring(row, start, 16), 16, 10).cast("decimal(20,0)")), F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), half(1).cast("string").alias("upper"), half(17).cast("string").alias("lower"))


def manifest_digest(manifest: DataFrame) -> str:
    """The digest of a manifest's rows as one text."""
    found = multiset_digest(manifest).first()
    return f"{found['n']}-{found['upper']}-{found['lower']}"


def provenance() -> dict[str, str | None]:
    """Where a run was made: the driver's host, Python, Spark, and the revision of this code, None where it is no checkout."""
    asked = subprocess.run(["git", "-C", str(Path(__file__).parent), "rev-parse", "HEAD"], capture_output=True, text=True, check=False) if shutil.which("git") else None
    revision = asked.stdout.strip() if asked is not None and asked.returncode == 0 else None
    return {"host": platform.node(), "python": platform.python_version(), "spark": pyspark.__version__, "revision": revision}


def write_raw(sampled: DataFrame, ablation: prep.Ablation, path: str) -> None:
    """Sampled rows as CSV text in a folder per table and target column, as they are (``stage=sampled``) and as a table encoder gets them (``stage=masked``).

    Groups have columns of their own, so lines are made here: a header, then a line per sample in the order of sample_id.
    """
    keys = ["table_id", "target"]
    named = sampled.withColumn("target", F.concat_ws("_", safe_name(F.col("target_col")), F.col("target_col_idx").cast("string")))
    targets = named.select("sample_id", *keys).distinct()
    cell = F.struct("col_idx", F.col("column").alias("header"), F.when(~F.col("is_null"), F.col("value")).alias("cell"))
    raw = named.groupBy("sample_id", *keys).agg(F.array_sort(F.collect_list(cell)).alias("cells")).withColumn("stage", F.lit("sampled"))
    masked = prep.tables(sampled, ablation).select("sample_id", "cells").join(targets, "sample_id").withColumn("stage", F.lit("masked"))
    rows = None
    for part in (raw, masked):
        texts = part.select(*keys, "stage", "sample_id", _csv_line("cells", "header").alias("header"), _csv_line("cells", "cell").alias("value"))
        rows = texts if rows is None else rows.unionByName(texts)
    folders = [*keys, "stage"]
    heads = rows.groupBy(*folders).agg(F.min("header").alias("value"), F.lit(None).cast("long").alias("sample_id"))
    lines = rows.drop("header").unionByName(heads)
    lines.repartition(*folders).sortWithinPartitions(*folders, F.col("sample_id").asc_nulls_first()).drop("sample_id").write.mode("overwrite").partitionBy(*folders).text(path)


def _csv_line(cells: str, field: str):
    """The cells' texts, quoted where CSV asks for it, in one line; nulls are empty."""
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(cells, lambda c: F.coalesce(quoted(c[field]), F.lit(""))), ",")


def write_attentions(spark: SparkSession, attentions: DataFrame, path: str, layers: list[int] | None = None, heads: list[int] | None = None, renormalise: bool = True) -> None:
    """Attention weights of samples as a table, a row per sample, layer and head; samples that are there already are replaced."""
    new = embed.attentions(attentions, layers, heads, renormalise)
    part = f"{path}.new"
    replace_table(spark, new, part)
    new = spark.read.schema(new.schema).parquet(part)
    if recover(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        new = old.join(new.select("sample_id").distinct(), "sample_id", "left_anti").unionByName(new)
    replace_table(spark, new, path)
    fs, found, _ = _file_system(spark, part)
    fs.delete(found, True)


#: What encodes the names of target columns for pooling; shorter vectors are padded to the context's size.
NAME_ENCODER = Encoder("names", "hashing", "hashing", 384)


def sampled_by_shard(spark: SparkSession, manifest: DataFrame, masked: DataFrame, path: str, shards: int) -> DataFrame:
    """The sampled rows' cells, written once at ``path`` in a folder per shard; every encoder, ablation and shard reads from there.

    Raises ValueError if samples have no row in the source: nothing may be assembled without them.
    """
    shard = F.pmod(F.xxhash64("table_id", "target_col_idx"), F.lit(shards)).cast("int")
    cells = prep.sampled_cells(manifest, masked).withColumn("shard", shard)
    if not exists(spark, f"{path}/_SUCCESS"):
        cells.write.mode("overwrite").partitionBy("shard").parquet(path)
    found = spark.read.schema(cells.schema).parquet(path)
    lost = manifest.select("sample_id", "table_id", "row_idx").join(found.select("sample_id").distinct(), "sample_id", "left_anti")
    if some := lost.take(5):
        message = f"{lost.count()} samples have no row in the source, such as {[tuple(r) for r in some]}"
        fs, target, _ = _file_system(spark, path)
        fs.delete(target, True)
        raise ValueError(message)
    return found


def embedded(sampled: DataFrame, encoder: Encoder, ablation: prep.Ablation, name_encoder: Encoder | None = None) -> DataFrame:
    """Samples, given as their rows' cells, with their vectors: prepared for the encoder's family, encoded, and pooled with the target's name where the ablation says so.

    Without a ``name_encoder``, a sentence encoder encodes names too; for others it is ``NAME_ENCODER``.
    """
    name_encoder = name_encoder or (NAME_ENCODER if encoder.family in embed.TABLE_FAMILIES else encoder)
    if ablation.target == "meanpool" and ablation.header != "preserve":
        raise ValueError(f"ablation {ablation.id!r}: meanpool needs the headers")
    if encoder.family in embed.TABLE_FAMILIES:
        made = prep.tables(sampled, ablation)
        found = embed.embed_tables(made, encoder.family, encoder.name, encoder.hidden_size)
    else:
        made = prep.sentences(sampled, ablation)
        found = embed.embed_column(made, "sentence", encoder.family, encoder.name, encoder.hidden_size)
    if ablation.target != "meanpool":
        return found
    names = made.select("target_name").distinct()
    names = embed.embed_column(names, "target_name", name_encoder.family, name_encoder.name, name_encoder.hidden_size, "name_embedding")
    pooled = vectors.mean_pool(F.col("embedding"), F.col("name_embedding"), encoder.hidden_size)
    return found.join(names, "target_name").withColumn("embedding", pooled)


def _write_shards(sampled: DataFrame, encoder: Encoder, ablation: prep.Ablation, path: str) -> None:
    """The prediction rows of the given shards in one job, a folder per shard, each in the place of what the shard had."""
    rows = vectors.prediction_dataset(embedded(sampled, encoder, ablation), encoder.hidden_size, shard="shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def run_one(spark: SparkSession, manifest: DataFrame, masked: DataFrame, encoder: Encoder, ablation: prep.Ablation, out_dir: str, shards: int = 1, retry_failed: bool = False, limit_groups: int | None = None) -> dict:
    """Run one encoder and ablation to ``out_dir/<encoder>/<ablation>``; returns the run's metadata.

    All shards that the ledger has not settled are one job. Should it fail, they are tried once more, each by itself, so that only those
    of a fault of their own are recorded as failed.
    """
    started = dt.datetime.now(dt.UTC)
    manifest = manifest if limit_groups is None else first_groups(manifest, limit_groups)
    base, book = f"{out_dir}/{encoder.id}/{ablation.id}", f"{out_dir}/ledger"
    digest = manifest_digest(manifest)
    this = {"encoder": encoder.id, "ablation": ablation.id, "manifest": digest, "shards": shards}

    def entries() -> DataFrame:
        return ledger.read(spark, book).where((F.col("encoder") == encoder.id) & (F.col("ablation") == ablation.id))

    if not entries().where((F.col("manifest") != digest) | (F.col("shards") != shards)).isEmpty():
        raise ValueError(f"{base} was begun with another manifest or number of shards; choose another folder")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    wanted = sorted(r["shard"] for r in ledger.open_work(every, entries(), ["shard"], retry_failed).collect())
    if wanted:
        sampled = sampled_by_shard(spark, manifest, masked, f"{out_dir}/sampled/{digest}-{shards}", shards)
        try:
            _write_shards(sampled.where(F.col("shard").isin(wanted)), encoder, ablation, f"{base}/shards")
            ledger.append(spark, book, [{**this, "shard": k, "state": "done"} for k in wanted])
        except Exception:  # which shards are at fault is found out below
            for k in wanted:
                state: dict = {"state": "done"}
                try:
                    _write_shards(sampled.where(F.col("shard") == k), encoder, ablation, f"{base}/shards")
                except Exception as error:  # a shard of any fault is recorded and the run goes on
                    state = {"state": "failed", "error": f"{type(error).__name__}: {error}"[:500]}
                ledger.append(spark, book, [{**this, "shard": k, **state}])
    states = {r["shard"]: r["state"] for r in ledger.latest(entries(), ["shard"]).collect()}
    done = sorted(k for k, state in states.items() if state == "done")
    whole = prediction_data(spark, base, done)
    if whole is not None:
        replace_table(spark, whole, f"{base}/pred_dataset.parquet")
    rows = 0 if whole is None else spark.read.parquet(f"{base}/pred_dataset.parquet").count()
    meta = {
        "encoder": encoder.id, "ablation": ablation.id, "hidden_size": encoder.hidden_size, "manifest": digest, "rows_total": rows, "shards_done": len(done), "shards_skipped": len(states) - len(done),
        **provenance(), "started": started.isoformat(), "duration_seconds": (dt.datetime.now(dt.UTC) - started).total_seconds(),
    }
    write_json(spark, f"{base}/metadata.json", meta)
    return meta


def first_groups(manifest: DataFrame, n: int) -> DataFrame:
    """The rows of the first ``n`` groups (table and target column) by name and position."""
    groups = manifest.select("table_id", "target_col_idx").distinct().orderBy("table_id", "target_col_idx").limit(n)
    return manifest.join(groups, ["table_id", "target_col_idx"], "left_semi")


def prediction_data(spark: SparkSession, base: str, done: list[int]) -> DataFrame | None:
    """The rows of all finished shards, or None if no shard is finished or none has rows."""
    if not done or not exists(spark, f"{base}/shards"):
        return None
    return spark.read.parquet(f"{base}/shards").where(F.col("shard").isin(done)).drop("shard")


def run_all(spark: SparkSession, manifest: DataFrame, masked: DataFrame, config: Config, out_dir: str, encoders: list[str] | None = None, ablations: list[str] | None = None, **options) -> list[dict]:
    """All chosen pairs of encoders and ablations, one after the other."""
    return [run_one(spark, manifest, masked, e, a, out_dir, **options) for e, a in config.selected(encoders, ablations)]


def clean_corpus(spark: SparkSession, folder: str, out_dir: str, limit: int | None = None, tables: list[str] | None = None) -> DataFrame:
    """Write the normal form of each of a corpus's files as a table of its own in ``out_dir``; returns the files passed over.

    Every cell becomes text, nulls stay nulls, headers are in normal form too. A table whose normalised headers collide is passed over, as it could not be
    a table with these headers. Files without rows have no cells and are not written.
    """
    cells, errors = read_corpus(spark, folder, limit, tables=tables)
    keys = ["table_id", "file_basename", "col_idx"]
    # A header is put in normal form once for its column, not for each cell.
    headers = staged(cells.select(*keys, "column").distinct().withColumn("clean", normalize(F.col("column"))), "headers")
    names = headers.groupBy("table_id", "file_basename", "clean").agg(F.count_distinct("col_idx").alias("n")).where("n > 1")
    collided = staged(names.groupBy("table_id", "file_basename").agg(F.max("n").alias("n")), "collided")
    fs, target, _ = _file_system(spark, out_dir)
    fs.mkdirs(target)
    found = opened_by_arrow(spark, out_dir)
    if found is None:
        raise ValueError(f"{out_dir} is in a store that only Spark can open; choose another folder for the tables")
    spark.dataSource.register(TableSink)
    kept = cells.join(headers.select(*keys, "clean").join(collided, ["table_id", "file_basename"], "left_anti"), keys)
    # A row's cells stay together, and a large table spreads over tasks by ranges of its rows. Cells are put in normal form after they are dealt out:
    # once, and by as many tasks as there are ranges, however few tasks have read the files.
    dealt = kept.select("table_id", "row_idx", "col_idx", F.col("clean").alias("column"), "value", "is_null").repartitionByRange("table_id", "row_idx")
    clean = dealt.withColumn("value", F.when(~F.col("is_null"), normalize(F.col("value")))).drop("is_null")
    clean.sortWithinPartitions("table_id", "row_idx", "col_idx").write.format("table_files").mode("append").option("path", found).save()
    return collided.select("file_basename", F.lit("colliding_headers").alias("skip_reason")).unionByName(errors.select("file_basename", "skip_reason"))
