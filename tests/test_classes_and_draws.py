"""Co-missing classes and draws of several columns against plain versions of their definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import profile, sampling

MASKED = "table_id string, file_basename string, row_idx long, col_idx int, column string, missing boolean"


def masked_of(spark, tables):
    """``tables``: name -> list of (column, set of missing rows, number of rows)."""
    rows = [(t, f"{t}.parquet", r, k, c, r in gone) for t, columns in tables.items() for k, (c, gone, n) in enumerate(columns) for r in range(n)]
    return spark.createDataFrame(rows, MASKED)


def classes_of(tables):
    out = set()
    for t, columns in tables.items():
        by_rows = {}
        for k, (c, gone, _) in enumerate(columns):
            if gone:
                by_rows.setdefault(frozenset(gone), []).append((k, c))
        out |= {(t, len(rows), tuple(members)) for rows, members in by_rows.items() if len(members) > 1}
    return out


@pytest.mark.parametrize("signature", [F.xxhash64, lambda c: F.lit(1).cast("long"), lambda c: (c % 2).cast("long")])
def test_classes_equal_definition(spark, signature):
    """Also where signatures say little, so that columns of other rows share them and get leaders of their own."""
    rng = random.Random(3)
    tables = {f"t{k}": [(f"c{rng.randint(0, 9)}", {r for r in range(5) if rng.random() < 0.4}, 5) for _ in range(14)] for k in range(4)}
    found = profile.co_missing_classes(masked_of(spark, tables), signature).collect()
    assert {(r.table_id, r.n_missing, tuple((m.col_idx, m.column) for m in r.members)) for r in found} == classes_of(tables)
    assert all(r.leader_idx == r.members[0].col_idx for r in found)
    pairs = {(r.table_id, r.col_idx, r.other_idx) for r in profile.co_missing_pairs(profile.co_missing_classes(masked_of(spark, tables), signature)).collect()}
    assert pairs == {(t, a[0], b[0]) for t, _, members in classes_of(tables) for a, b in itertools.permutations(members, 2) if a[1] != b[1]}


def test_wide_table_is_one_class(spark):
    """2,000 columns that miss the same rows are one class with membership, not two million pairs."""
    wide = spark.range(2000).select(F.lit("t").alias("table_id"), F.lit("t.parquet").alias("file_basename"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("row_idx"), F.col("id").cast("int").alias("col_idx"), F.concat(F.lit("c"), "id").alias("column"))
    classes = profile.co_missing_classes(wide.withColumn("missing", F.col("row_idx") < 3))
    assert [(r.leader_idx, r.n_missing, len(r.members)) for r in classes.collect()] == [(0, 3, 2000)]
    lists = profile.co_missing_lists(classes)
    assert [(r.n, r.least) for r in lists.agg(F.count("*").alias("n"), F.min("n_co_missing").alias("least")).collect()] == [(2000, 1999)]


def test_nothing_missing_has_no_class(spark):
    assert profile.co_missing_classes(masked_of(spark, {"t": [("a", set(), 3), ("b", set(), 3)]})).count() == 0


def greedy(found, n, low, k, cap):
    """(table, column) -> (missing rows, present rows) by the definition."""
    out = {}
    for table in sorted({r[0] for r in found}):
        used, drawn = set(), 0
        columns = sorted({(r[2], r[1], r[3]) for r in found if r[0] == table})
        for _, col, prior in columns:
            if drawn == k:
                break
            free = {m: [row for _, row in sorted((r[6], r[4]) for r in found if r[0] == table and r[1] == col and r[5] == m) if row not in used] for m in (True, False)}
            size = min(n, len(free[True]), len(free[False]))
            if size < low or prior + 2 * size > cap:
                continue
            out[table, col] = (free[True][:size], free[False][:size])
            used |= set(free[True][:size]) | set(free[False][:size])
            drawn += 1
    return out


@pytest.mark.parametrize("n, low, k, cap", [(2, 1, 3, 20), (3, 3, 4, 20), (5, 1, 2, 7), (1, 1, 9, 20)])
def test_draw_many_equals_greedy(spark, n, low, k, cap):
    """Few rows that all columns want, so that later columns come short; tables without any column that can be drawn."""
    rng = random.Random(n)
    found = []
    for t in range(6):
        for c in range(8):
            missing = {r for r in range(12) if rng.random() < (0.5 if t else 0.0)}
            order = {m: rng.sample(sorted(r for r in range(12) if (r in missing) == m), sum((r in missing) == m for r in range(12))) for m in (True, False)}
            found += [(f"t{t}", c, (c * 5) % 8 + 1, (c % 3) * 4, r, m, p + 1) for m in (True, False) for p, r in enumerate(order[m])]
    df = spark.createDataFrame([(t, f"{t}.parquet", *r) for t, *r in found], "table_id string, file_basename string, col_idx int, column_rank int, n_prior int, row_idx long, missing boolean, order int")
    got = {}
    for r in sampling.draw_many(df, n, low, k, cap).orderBy("order").collect():
        got.setdefault((r.table_id, r.col_idx), ([], []))[0 if r.missing else 1].append(r.row_idx)
        assert r.drawn == len(greedy(found, n, low, k, cap)[r.table_id, r.col_idx][0])
    assert got == greedy(found, n, low, k, cap)
