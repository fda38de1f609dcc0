"""The hashing encoder against its definition in plain Python."""

import hashlib
import math
import random

import pytest

from lacuna.plans import embed


def signed(words, size):
    out = [0.0] * size
    for w in words:
        digest = hashlib.md5(w.encode()).hexdigest()
        out[int(digest[:8], 16) % size] += 1 if digest[8] < "8" else -1
    return out


def test_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "Größe", "[?]", "[EMPTY]", "x:"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["", None, " \t\n", "a b c", "a b", "a b", "w" * 5000]
    found = embed.embed_column(spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "k long, t string, place string"), "t", "hashing", "hashing", 16)
    rows = {r.k: r.embedding for r in found.collect()}
    assert len(rows) == len(texts) and found.columns == ["k", "t", "place", "embedding"]
    for k, t in enumerate(texts):
        sums = signed((t or "").split(), 16)
        norm = math.sqrt(sum(x * x for x in sums)) or 1
        assert rows[k] == pytest.approx([x / norm for x in sums], abs=1e-6), t


def test_tables(spark):
    rng = random.Random(2)
    word = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 4)))
    tables = [([(word(), word() or None) for _ in range(rng.randint(0, 5))], None) for _ in range(40)]
    tables += [(cells, rng.randrange(len(cells)) if cells else None) for cells, _ in tables]
    found = embed.embed_tables(spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(tables)], "k long, cells array<struct<header: string, cell: string>>, target_position int"), "hashing_table", "hashing", 8)
    rows = {r.k: r.embedding for r in found.collect()}
    assert len(rows) == len(tables)
    for k, (cells, target) in enumerate(tables):
        vectors = []
        for header, cell in cells:
            words = f"{header} {cell}".split() if cell else []
            vectors.append([x / len(words) for x in signed(words, 8)] if words else [0.0] * 8)
        want = vectors[target] if target is not None else [sum(v[i] for v in vectors) / len(vectors) for i in range(8)] if vectors else [0.0] * 8
        assert rows[k] == pytest.approx(want, abs=1e-6), (cells, target)
