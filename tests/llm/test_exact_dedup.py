import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lacuna.llm import exact_dedup

SCHEMA = "doc_id long, text string, rid string, hash int"


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (key, _), text in zip(rows, norm, strict=True):
        ids = [k for (k, _), x in zip(rows, norm, strict=True) if x == text]
        known = [k for k in ids if k is not None]
        out.append((key, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))], ids=["xxhash64", "colliding"])
def test_matches_brute_force(spark, hashed):
    long = "".join(f"word{i} " for i in range(300))
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, " "), (8, long), (4, long.replace(" ", "\n")), (6, long + "x"), (10, "é" * 50), (11, "é" * 50), (None, "a b")]
    rows += [(20, "same"), (20, "same"), (20, "other"), (12, "word0 " * 64), (13, "word0 " * 65)]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], SCHEMA)
    found = exact_dedup.duplicates(df, block_bytes=16, block_hash=hashed).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == brute(rows)
    kept = {}
    for r in found:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_keep_first_returns_whole_rows_once(spark):
    df = spark.createDataFrame([(1, "a", "x", 0), (1, "a", "x", 0), (1, "b", "y", 1), (2, "a", "z", 2), (3, None, "n", 3), (4, "", "e", 4)], SCHEMA)
    found = exact_dedup.keep_first(df)
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", "x", 0), (1, "b", "y", 1), (3, None, "n", 3)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicates(df).count() == 0
    assert exact_dedup.keep_first(df).count() == 0
