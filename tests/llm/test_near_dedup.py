import random
import re
from collections import Counter

import numpy as np

from lacuna.llm import near_dedup as nd


def brute_classes(docs):
    """Classes by all pairs of plain Jaccard similarities of word 5-shingles."""
    sets = {}
    for k, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / union >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []

    def add(text):
        docs.append((len(docs), text))

    shared = " ".join(word() for _ in range(60))
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 150, 400]))]
        add(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 25])):
            copy = base.copy()
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            add(rng.choice([" ", "  \n"]).join(copy) + rng.choice(["", "."]))
    chain = [word() for _ in range(300)]
    for _ in range(15):  # each like the one before it, the ends unlike
        add(" ".join(chain))
        at = rng.randrange(290)
        chain[at : at + 8] = [word() for _ in range(8)]
    for n in (20, 30, 60, 100) * 6:
        add(shared + " " + " ".join(word() for _ in range(n)))
    docs += [(1000, None), (1001, ""), (1002, "!!"), (1003, "One two"), (1004, "one  two."), (1005, "same " * 300), (1006, "same " * 310)]
    return docs


def test_classes_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, rid string").repartition(3)
    for config in (nd.Config(), nd.Config(block=4)):
        found = nd.near_duplicates(df, config).collect()
        assert {r.doc_id: r.class_id for r in found} == brute_classes(docs)
        sizes = Counter(brute_classes(docs).values())
        assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)


def test_unequal_repetition_does_not_part_texts(spark):
    """A copy whose last words are repeated has nearly the same set of shingles, in lone pairs and among others."""
    rng = random.Random(5)
    docs = []
    for n, repeated, times in [(100, 15, 100), (100, 15, 1000), (200, 40, 200)] * 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        docs.append((len(docs), " ".join(words)))
        docs.append((len(docs), " ".join(words + words[-repeated:] * times)))
        if len(docs) % 4 == 0:
            words[0] += "x"
            docs.append((len(docs), " ".join(words)))
            docs.append((len(docs), " ".join(words + words[:repeated] * times)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()} == brute_classes(docs)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 0), (1, text, 0), (2, text + " more", 1), (3, "else", 2), (1, "third", 3), (None, text, 4), (7, None, 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __x int")
    assert sorted(map(tuple, nd.keep_one(df).collect()), key=str) == sorted([(1, text, 0), (3, "else", 2), (1, "third", 3), (7, None, 5), (8, "", 6)], key=str)
    assert nd.keep_one(df.where("doc_id > 6")).count() == 2
    assert nd.keep_one(df.limit(0)).count() == 0


def test_a_pair_is_met_in_the_first_band_whose_key_both_have():
    config = nd.Config()
    kept = np.random.default_rng(2).integers(1, 2**63, config.registers, dtype=np.uint64)
    kept = np.stack([kept, kept])
    kept[1, 4] += np.uint64(256)  # the first band differs, but not in low bytes
    bands = np.empty(2, dtype=object)
    bands[:] = list(nd.band_keys(kept, config.bands, config.rows))
    low = np.array([k.tobytes() for k in (kept & np.uint64(255)).astype(np.uint8)], dtype=object)
    rows = {"outlier": np.array([True, False]), "class": np.array([1, 2]), "low": low, "bands": bands}
    met = [band for band in range(config.bands) if list(nd._likely({**rows, "band": np.array([band, band])}, 0, 2, config))]
    assert met == [1]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**63, 300, dtype=np.uint64)
    weights = rng.uniform(0.5, 4, 300)
    a, b = slice(0, 240), slice(60, 300)
    wb = weights.copy()
    wb[60:240] *= rng.choice([1, 2], 180)
    owner = np.repeat([0, 1], 240)
    kept = nd.prob_min_hash(owner, np.concatenate([elements[a], elements[b]]), np.concatenate([weights[a], wb[b]]), 2, 4096)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = weights[a], wb[b]
    expected = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(60, 240))
    assert abs((kept[0] == kept[1]).mean() - expected) < 0.04
    assert (nd.prob_min_hash(owner, np.concatenate([elements[a], elements[b]]), np.concatenate([weights[a], wb[b]]), 2, 4096, chunk=50) == kept).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (70, 100), (70, 70), (60, 61)]
    found = nd.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["class"] for r in found} == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50, 60: 60, 61: 60}
