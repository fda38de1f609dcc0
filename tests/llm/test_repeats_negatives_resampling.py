"""Operators 11 to 13 against brute force, with hot groups, ties, repeated rows, nulls and large ids."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lacuna.llm import hard_negatives, resampling, substrings

BIG = [2**60 + 1, None, 2**60 + 3]


# ------------------------------------------------------------------------------------ passages of earlier documents


def removed(docs, length):
    """Kept words of each row of (id, text) by the definition."""
    split = [(k, (t or "").encode().split()) for k, t in docs]
    first = {}
    for k, w in split:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, math.inf), math.inf if k is None else k)
    out = []
    for k, w in split:
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < (math.inf if k is None else k):
                gone.update(range(p, p + length))
        out.append((k, len(w), len(gone), " ".join(x.decode() for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def found_repeats(spark, docs, config):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc": F.lit("x"), "seed": F.lit(1), "of_doc": F.lit(None).cast("int")})
    got = substrings.remove_repeats(df, config).collect()
    for r in got:
        assert sum(s["n"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str)


@pytest.mark.parametrize("most", [1, 512])
def test_repeats_equal_brute_force(spark, most):
    """Few different words, so that windows repeat; a frequent passage; at ``most`` 1 every shard of two regions is dealt again."""
    rng = random.Random(most)
    passage = " ".join(f"p{k}" for k in range(14))
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for k in range(40)]
    docs += [(100 + k, f"{' '.join(rng.choice('defgh') for _ in range(9))} {passage}\n{' '.join(rng.choice('ijkl') for _ in range(9))}") for k in range(40)]
    docs += [(7, docs[7][1]), (7, passage), (None, passage + " x"), (None, passage + " x"), (200, None), (201, ""), (202, " \t\v\f\r\n"), (203, "a " * 300), (204, "a " * 200), (205, "é ü " * 20)]
    docs += [(BIG[0], passage), (BIG[2], passage + " last"), (BIG[0] + 1, "own words only here and no more than these few that are of no other text")]
    assert found_repeats(spark, docs, substrings.Config(length=10, seeds=(4, 10), most=most)) == removed(docs, 10)


def test_automaton_gives_matching_statistics():
    rng = random.Random(4)
    for _ in range(60):
        known = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))] for _ in range(3)]
        automaton = substrings.SuffixAutomaton()
        for words in known:
            automaton.add(words)
        parts = {tuple(w[i:j]) for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        asked = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        longest = [max((n for n in range(1, k + 2) if tuple(asked[k + 1 - n : k + 1]) in parts), default=0) for k in range(25)]
        assert automaton.matches(asked) == longest


def test_last_seed_is_a_window(spark):
    with pytest.raises(ValueError):
        substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), substrings.Config(length=50, seeds=(16,)))


# ------------------------------------------------------------------------------------ hard negatives


def mined(rows, config):
    sound = [(r, i, l, [math.floor(config.scale * x) for x in v]) for r, (i, l, v) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, l, v in sound:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, s, m == l) for s, j, m, w in sound if len(w) == len(v)]
        for p in sorted(x for x in scored if x[3] and x[2] != r)[: config.positives]:
            inside = sorted(x for x in scored if not x[3] and config.share * -p[0] <= -100 * x[0] <= config.share_to * -p[0])
            out += [(i, p[1], k + 1, n[1], -p[0], -n[0]) for k, n in enumerate(inside[: config.negatives])]
    return sorted(out)


def found_negatives(spark, rows, config):
    df = spark.createDataFrame([(i, l, v, "x", 1) for i, l, v in rows], "vec_id long, label int, embedding array<float>, window string, rid int")
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, config).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


@pytest.mark.parametrize("gather", [3, 32])
def test_negatives_equal_brute_force(spark, gather):
    """Vectors of few values, so that scores tie far beyond ``gather``; repeated ids, odd rows, several blocks of anchors."""
    rng = random.Random(gather)
    vector = lambda: [rng.choice([0.5, 0.25, -0.125, 1.0]) for _ in range(3)]
    rows = [(k * 10 + rng.choice([0, 2**58]), rng.choice([0, 0, 0, 1, 2]), vector()) for k in range(150)]
    rows += [(5000, 1, [0.5, 0.5, 0.5])] * 40 + [(-50, 0, [1.0, 1.0, 1.0]), (BIG[0] - BIG[0] % 50, 0, [0.7, 0.5, 0.5])]
    rows += [(None, 0, vector()), (100, None, vector()), (150, 0, None), (200, 0, []), (250, 0, [0.5, None, 0.5]), (300, 0, [math.nan, 0.5, 0.5]), (350, 0, [math.inf, 1.0, 1.0]), (400, 0, [0.5, 0.5]), (401, 0, [0.5, 0.25]), (402, 1, [0.25, 0.5])]
    config = hard_negatives.Config(gather=gather, anchors=16, slices=3, digit=4)
    assert found_negatives(spark, rows, config) == mined(rows, config)


def test_negatives_of_few_rows(spark):
    config = hard_negatives.Config()
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])]):
        assert found_negatives(spark, rows, config) == mined(rows, config)


# ------------------------------------------------------------------------------------ importance resampling


def resampled(docs, target, config):
    def features(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        runs = [" ".join(words[k : k + n]) for n in range(1, config.longest + 1) for k in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % config.buckets for r in runs)

    found, aim = [features(t) for _, t in docs], Counter()
    for t in target:
        aim.update(features(t)[1])
    source = sum((f for _, f in found), Counter())
    n, m = sum(source.values()) + config.buckets, sum(aim.values()) + config.buckets
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * n / ((source[b] + 1) * m)))
    rows = []
    for (k, _), (words, f) in zip(docs, found):
        h = int(sha256(f"{config.seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(c * gain(b) for b, c in f.items())
        rows.append([k, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= config.least_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: config.percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_definition(spark, longest):
    rng = random.Random(longest)
    words = [f"w{k}" for k in range(60)] + ["Größe", "ÄÖ", "A1", "ABC", "naïve"]
    docs = [(k, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    docs += [(200 + k, docs[3][1] + " and " + docs[4][1]) for k in range(60)] + [(300, None), (301, ""), (302, "  ...")] + [(i, docs[5][1] + docs[6][1]) for i in BIG] + [docs[9], docs[9]]
    target = [" ".join(words[:20]), None, " ".join(words[:20]), ""]
    config = resampling.Config(longest=longest, buckets=50, least_words=5, percent=30)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, key string, rank int")
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), config).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(docs, target, config)


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert [tuple(r) for r in resampling.resample(some, none).select("doc_id", "n_features", "rank").collect()] == [(1, 2, None)]
