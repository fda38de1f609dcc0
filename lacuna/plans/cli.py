"""Command line: clean, sample, prune, tokens and run, each over Spark paths.

    python -m lacuna.plans.cli sample --datasets DIR --out DIR [--n 5] [--columns 1] ...
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.lexicon import PRIORITY_PATTERN
from lacuna.operators import occurrences, profile, sampling, tokens
from lacuna.plans import config, runner
from lacuna.sources.corpus import read_corpus


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lacuna", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needs: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        for need in needs:
            made.add_argument(f"--{need}", required=True)
        made.add_argument("--limit-files", type=int)
        made.add_argument("--seed", type=int, default=42)
        return made

    command("clean", "datasets", "out")
    draw = command("sample", "datasets", "out")
    draw.add_argument("--n", type=int, default=5)
    draw.add_argument("--min-n", type=int)
    draw.add_argument("--columns", type=int, default=1)
    draw.add_argument("--strict", action="store_true", help="also screen unique ids, free text and aggregates")
    draw.add_argument("--raw-labels", action="store_true")
    draw.add_argument("--no-priority", action="store_true")
    draw.add_argument("--again", action="store_true", help="columns that were drawn before may be drawn again")
    draw.add_argument("--occurrences", action="store_true")
    draw.add_argument("--occurrence-list", help="a CSV list of occurrences, whose values are the tokens of its cells")
    draw.add_argument("--run-rule", choices=["columns", "last"], default="columns", help="number a file's next run by the columns it has given, or by its last run plus one")
    prune = command("prune", "out")
    for x in (draw, prune):
        x.add_argument("--max-per-file-column", type=int, default=20)
        x.add_argument("--max-per-column-type", type=int)
    command("tokens", "datasets", "out")
    run = command("run", "datasets", "manifest", "config", "out")
    run.add_argument("--encoder", action="append")
    run.add_argument("--ablation", action="append")
    run.add_argument("--shards", type=int, default=1)
    run.add_argument("--retry-failed", action="store_true")
    run.add_argument("--limit-groups", type=int, help="only the first groups, to try a run")
    return top


def sample(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Draw a run on top of the manifest in ``out``, if there is one, and put the longer manifest in its place."""
    masked, errors = read_corpus(spark, a.datasets, a.limit_files, profile.with_mask)
    path = f"{a.out}/sample_manifest.parquet"
    old = spark.read.parquet(path) if runner.recover(spark, path) else None
    low = a.n if a.min_n is None else a.min_n
    found = profile.eligibility(profile.column_profile(masked), min_n=low, strict=a.strict)
    lists = profile.co_missing_lists(profile.co_missing_classes(masked))
    listed, rejected = occurrences.read_occurrences(spark, a.occurrence_list) if a.occurrence_list else (None, None)
    new = sampling.build_manifest(
        masked, found.where("reason is null"), lists, old, n=a.n, min_n=a.min_n, columns_per_table=a.columns, skip_drawn=not a.again, priority=None if a.no_priority else PRIORITY_PATTERN,
        max_per_file_column=a.max_per_file_column, max_per_column_type=a.max_per_column_type, seed=a.seed, first_id=0 if old is None else sampling.next_sample_id(old), label_mode="raw" if a.raw_labels else "label", run_rule=a.run_rule, occurrences=listed,
    )
    # Written first: what follows must not depend on the manifest that is about to be replaced.
    runner.replace_table(spark, new, f"{a.out}/last_run")
    new = spark.read.schema(new.schema).parquet(f"{a.out}/last_run")
    prior = sampling.prior_state(old, a.run_rule) if old is not None else None
    tried = sampling.candidates(masked, found.where("reason is null"), prior, a.seed, a.n * (2 * a.columns - 1), not a.again, None if a.no_priority else PRIORITY_PATTERN)
    options = {"n": a.n, "min_n": a.min_n, "columns_per_table": a.columns, "max_per_file_column": a.max_per_file_column}
    capped = None if a.max_per_column_type is None else sampling.label_capped(tried, new, **options)
    sampling.audit(found, new, tried, **options, label_capped=capped).write.mode("append").parquet(f"{a.out}/summary")
    profile.co_missing_report(found, lists).write.mode("append").parquet(f"{a.out}/co_missing")
    errors.write.mode("append").parquet(f"{a.out}/read_errors")
    if rejected is not None:
        rejected.write.mode("append").parquet(f"{a.out}/rejected_occurrences")
    if a.occurrences:
        marks = tokens.occurrences(masked)
        marks.write.mode("overwrite").option("header", True).csv(f"{a.out}/special_tokens/occurrences")
        tokens.occurrence_summary(marks).write.mode("overwrite").option("header", True).csv(f"{a.out}/special_tokens/summary")
    runner.replace_table(spark, new if old is None else sampling.append(old, new), path)
    counts = new.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("table_id", "target_col_idx").alias("columns"), F.count_distinct("table_id").alias("tables")).first().asDict()
    runner.write_json(spark, f"{a.out}/last_run.json", {"options": {k: v for k, v in vars(a).items() if k != "command"}, "new": counts, "manifest": runner.manifest_digest(spark.read.parquet(path)), **runner.provenance(), "at": dt.datetime.now(dt.UTC).isoformat()})
    return sampling.balance_violations(new, a.n, low)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lacuna").getOrCreate()
    if a.command == "clean":
        runner.clean_corpus(spark, a.datasets, a.out, a.limit_files).show(truncate=False)
    elif a.command == "sample":
        sample(spark, a).show(truncate=False)
    elif a.command == "prune":
        path = f"{a.out}/sample_manifest.parquet"
        runner.recover(spark, path)
        pruned = sampling.prune_to_caps(spark.read.parquet(path), a.max_per_file_column, a.max_per_column_type, a.seed)
        sampling.check_caps(pruned, a.max_per_file_column, a.max_per_column_type)
        runner.replace_table(spark, pruned, path)
    elif a.command == "tokens":
        masked, _ = read_corpus(spark, a.datasets, a.limit_files, profile.with_mask)
        made = tokens.token_manifest(masked, profile.co_missing_lists(profile.co_missing_classes(masked)), a.seed)
        runner.replace_table(spark, made, f"{a.out}/token_manifest.parquet")
        tokens.token_group_counts(spark.read.parquet(f"{a.out}/token_manifest.parquet")).show()
    else:
        masked, _ = read_corpus(spark, a.datasets, a.limit_files, profile.with_mask)
        for meta in runner.run_all(spark, spark.read.parquet(a.manifest), masked, config.load_config(a.config), a.out, a.encoder, a.ablation, shards=a.shards, retry_failed=a.retry_failed, limit_groups=a.limit_groups):
            print(meta)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
