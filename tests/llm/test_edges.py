"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator on documents."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import chat, exact_dedup, gif, html_text, licenses, near_dedup, packing, quality, resampling, substrings, tokens, toxicity

LONG = "Licensed under the MIT License. " + "wörd and other things to say " * 8000
ROWS = [(1, "a short text of some words that is repeated here"), (1, "a short text of some words that is repeated here"), (2, None), (3, ""), (None, "no id at all but words"), (4, LONG), (5, " \n\t "), (6, "a short text of some words that is repeated here")]
SCHEMA = "doc_id long, text string, id string, rid int, name string, hash long, pos int, label int, score double, html string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, None, 2, None, 3, 0.5, None) for k, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame([(k, i % 2, (i + 1) % 2) for i, (k, _) in enumerate(rows)], "doc_id long, quality int, toxic int")


def run(spark, rows, name):
    df = frame(spark, rows)
    return {
        "licenses": lambda: licenses.scan(df),
        "packing": lambda: packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")),
        "exact": lambda: exact_dedup.duplicates(df),
        "exact_rows": lambda: exact_dedup.keep_first(df),
        "quality": lambda: quality.score(df, quality.fit(df, labels(spark, rows))),
        "quality_rows": lambda: quality.keep_good(df, quality.fit(df, labels(spark, rows))),
        "toxicity": lambda: toxicity.score(df, toxicity.fit(df, labels(spark, rows))),
        "toxicity_rows": lambda: toxicity.keep_clean(df, toxicity.fit(df, labels(spark, rows))),
        "near": lambda: near_dedup.near_duplicates(df),
        "near_rows": lambda: near_dedup.keep_one(df),
        "tokens": lambda: tokens.token_digests(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "media": lambda: gif.store_texts(df),
        "html": lambda: html_text.extract(df, ("doc_id", "name"), "text"),
        "chat": lambda: chat.format_chats(df, "text"),
        "repeats": lambda: substrings.remove_repeats(df),
        "resampling": lambda: resampling.resample(df, df),
    }[name]()


WIDE = [(2**60 + 1, "first text of some words"), (None, "another text without any id"), (2**60 + 3, "third text, unlike the others")]


def test_large_ids_beside_a_null(spark):
    """Ids beyond 2^53 in one partition with a null come back unchanged, and no document is lost."""
    df = spark.createDataFrame(WIDE, "doc_id long, text string").coalesce(1).withColumn("__id", F.lit("clash"))
    known = spark.createDataFrame([(k, 1, 0) for k in range(4)], "doc_id long, quality int, toxic int")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = {
        "packing": packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")),
        "quality": quality.score(df, quality.fit(df, known)),
        "toxicity": toxicity.score(df, toxicity.fit(df, known)),
        "near": near_dedup.near_duplicates(df),
        "near_rows": near_dedup.keep_one(df),
        "exact_rows": exact_dedup.keep_first(df),
        "tokens": tokens.token_digests(df, ranks, public_tokenizers.PATTERN),
        "media": gif.store_texts(df),
        "html": html_text.extract(df, ("doc_id",), "text"),
        "repeats": substrings.remove_repeats(df),
        "resampling": resampling.resample(df, df),
    }
    for name, frame_ in found.items():
        ids = [r["doc_id"] for r in frame_.collect()]
        assert set(ids) == {k for k, _ in WIDE}, name
        assert name == "packing" or len(ids) == len(WIDE), name
        assert dict(frame_.dtypes)["doc_id"] == "bigint", name


def test_chat_keeps_other_columns(spark):
    df = spark.createDataFrame([('{"messages": [{"role": "user", "content": "hi"}]}', 5)], "text string, __record int")
    assert chat.canonical_turns(df, "text").first()["__record"] == 5


NAMES = ["licenses", "packing", "exact", "exact_rows", "quality", "quality_rows", "toxicity", "toxicity_rows", "near", "near_rows", "tokens", "media", "html", "chat", "repeats", "resampling"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    found = run(spark, ROWS, name).collect()
    ids = sorted((r["doc_id"] for r in found), key=str)
    if name == "packing":
        assert set(ids) == {1, 2, 3, None, 4, 5, 6}
        assert sum(r["length"] for r in found if r["doc_id"] == 2) == 1
    elif name in ("exact_rows", "near_rows"):
        # Equal texts leave one row; texts without words are copies for one and left alone by the other.
        assert ids == sorted({"exact_rows": [1, 2, None, 4, 5], "near_rows": [1, 2, 3, None, 4, 5]}[name], key=str)
        assert set(found[0].asDict()) == set(frame(spark, []).columns)
    elif name.endswith("_rows"):
        assert set(found[0].asDict() if found else frame(spark, []).columns) == set(frame(spark, []).columns)
    else:
        assert ids == sorted((k for k, _ in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert run(spark, [], name).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    """A whole run over a small folder: toxic and poor documents and copies go, the rest is packed whole."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    docs, tags = [], []
    for k in range(400):
        words = [word() for _ in range(60)]
        toxic, poor = k % 5 == 1, k % 5 == 2
        if toxic:
            words[10:10] = ["vilename", "wretchname"]
            words[40:40] = ["vilename"]
        text = " ".join(words)
        docs.append((k, text.upper() + "!! ###" * 30 if poor else text, "en", "s", 1))
        tags.append((k, 0 if poor else 1, int(toxic)))
    clean = [d for d in docs if d[0] % 5 in (0, 3, 4)]
    docs += [(1000, clean[0][1].replace(" ", "\n"), "en", "s", 1), (1001, clean[1][1] + " tail", "en", "s", 1), (1002, clean[2][1], None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(tags, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces["doc_id"]) == {d[0] for d in clean}
    assert pieces.groupby("doc_id")["length"].sum().eq(pieces.groupby("doc_id")["doc_tokens"].first()).all()
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns
