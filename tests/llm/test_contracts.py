"""Results of the queries' operators against plain versions: digests, folds, convolution, GIF columns, near copies of a whole table."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lacuna.llm import catalog, chat, gif, labelled, near_dedup, packing, quality, tokens, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("white", [" ", "\t", "\n", " \n", "\xa0"])
def test_white_space_beyond_the_splitting_engine(white):
    """A run's ids do not depend on its length: what lies around it is encoded as around a short run."""
    multi, plain = tokens.load_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.json")
    for before, after in (("a", "b"), ("", ""), ("!", "'s")):
        whole = before + white * (900_000 // len(white)) + after
        assert tokens.encode_text(multi, whole) == multi.encode_ordinary(whole)
        for n in (1_000_100, 2_000_000, 5_000_000) if before == "a" else (1_000_100,):
            text = before + white * (n // len(white)) + after
            assert multi.decode_bytes(tokens.encode_text(multi, text)) == text.encode()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(plain)
    tokenizer.encode_special_tokens = True
    text = "a" + white * (2_000_000 // len(white)) + "b"
    assert [*packing.load_encoder(plain)([text])][0] == tokenizer.encode(text, add_special_tokens=False).ids


def test_conversations_of_any_length_keep_their_roles(spark):
    rows = spark.createDataFrame([(1, 0, "human", "a"), (1, 2, None, None), (2, 0, "GPT", "b\\")], "conv_id long, turn long, role string, text string")
    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.expr("repeat('ab#</turn>', 2500000)").alias("text"))
    found = {r.conv_id: r for r in chat.conversation_digests(rows.union(long)).collect()}
    text = "ab#</turn>" * 2_500_000
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (3, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert found[1].turns_sha256 == hashlib.sha256(f"human\na\nassistant\n{text}\n\n\n".encode()).hexdigest()
    assert found[2].turns_sha256 == hashlib.sha256(b"GPT\nb\\\n").hexdigest()
    foreign = spark.range(1).select(F.to_json(F.struct(F.expr("repeat('ab', 12000000)").alias("prompt"), F.lit("c").alias("completion"))).alias("record"))
    assert {r.layout: r.n_records for r in chat.format_counts(foreign.union(spark.createDataFrame([("{",), (None,)], "record string")), "record").collect()} == {"prompt_completion": 1, None: 2}


def test_folds_and_predictions(spark):
    docs = spark.createDataFrame([(k, f"text {k} of some words" * (k % 5)) for k in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    for module, folds, fold in ((quality, 5, 0), (toxicity, 4, 2)):
        for r in module.score(docs, module.fit(docs, labels)).collect():
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_an_id_in_many_rows_is_sampled_once(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int")
    found = labelled.labelled_sample(docs, labels, "quality", 5, 4, 10)
    drawn = [k for k in range(3) if zlib.crc32(str(k).encode()) % 5 != 4]
    assert sorted(tuple(r) for r in found.collect()) == [(k, k % 2, "t0") for k in drawn]


def test_quality_learns_from_texts_of_any_length(spark):
    """Labelled texts are seen whole: what tells the classes apart stands after 40,000 characters of each, and training from texts gives the same machine."""
    plain = "some words that all texts share " * 1300
    rows = [(k, plain + ("good ending here " if k % 2 else "%%% ||| ")) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert all((r.score >= 0.3) == bool(r.doc_id % 2) for r in quality.score(docs, model).collect())
    used = [(t, k % 2) for k, t in rows if zlib.crc32(str(k).encode()) % 5]
    same = quality.train([t for t, _ in used], np.array([v for _, v in used]))
    assert model.shift == same.shift and (model.weights == same.weights).all() and (model.factors == same.factors).all()


def test_statistics_by_definition():
    text = "Ab cd cd 12!\n| x. \u00e9\u00e9"
    words = text.split()
    found = dict(zip(quality.STATISTICS, quality.statistics(text, quality.Words(1 << 18)(text), len(set(words))), strict=True))
    raw = text.encode()
    n, w = len(raw), len(words)
    wanted = {
        "bytes": np.log1p(n), "words": np.log1p(w), "lines": np.log1p(2), "wide": 4 / n, "upper": 1 / 7, "lower": 6 / n, "digits": 2 / n, "ends": 2 / w, "bars": 1 / w,
        "signs": 0, "repeats": 1 / w, "distinct": len(set(words)) / w, "word_bytes": n / w, "line_words": w / 2, "long_lines": 0,
    }
    assert (w, n) == (7, 22) and len(wanted) == len(found)
    for name, value in wanted.items():
        assert abs(found[name] - value) < 1e-12, name


def test_cut_has_the_best_balanced_accuracy():
    """Of all cuts between two logits, none is better; with one class there is none to choose."""
    rng = np.random.default_rng(8)
    for size in (2, 3, 10, 50):
        for _ in range(40):
            labels = rng.integers(0, 2, size)
            logits = rng.integers(-5, 6, size).astype(float)
            cut = quality._cut(logits, labels)
            if labels.min() == labels.max():
                assert cut == 0.0
                continue
            value = lambda at: np.mean(logits[labels == 1] > at) + np.mean(logits[labels == 0] < at)
            assert value(cut) == max(value(at) for at in np.arange(-6.5, 7, 1))


def test_convolution_equals_its_definition():
    """Embeddings summed from pieces, each filter at each place of the text, the largest response, the output layer."""
    rng = np.random.default_rng(3)
    config = toxicity.Config(buckets=500)
    rows = {int(b): k + 1 for k, b in enumerate(rng.permutation(500)[:300])}
    table = np.concatenate([np.zeros((1, config.dim)), rng.normal(size=(300, config.dim))]).astype(np.float32)
    kernels = [rng.normal(size=(w, config.dim, config.filters)).astype(np.float32) for w in config.widths]
    biases = [rng.normal(size=config.filters).astype(np.float32) for _ in config.widths]
    model = toxicity.Model(config, rows, table, kernels, biases, rng.normal(size=config.filters * len(config.widths)).astype(np.float32), 0.3)
    texts = [" ".join(rng.choice(["the", "alpha", "betatron", "gammas", "deltalike", "x"], n)) for n in (1, 2, 3, 40)]
    logits, _ = toxicity.Scorer(model, chunk=7).logits(texts)
    for text, logit in zip(texts, logits, strict=True):
        words = [sum((table[rows.get(b, 0)] for b in toxicity.piece_hashes(w, 500)), np.zeros(config.dim)) for w in toxicity.words_of(text)]
        words += [np.zeros(config.dim)] * (max(config.widths) - 1)  # beyond the end there is no word
        hidden = []
        for kernel, bias, width in zip(kernels, biases, config.widths, strict=True):
            for f in range(config.filters):
                places = range(len(toxicity.words_of(text)))
                hidden.append(max(0.0, max(sum(float(words[p + o] @ kernel[o, :, f]) for o in range(width)) for p in places) + float(bias[f])))
        assert abs(float(np.array(hidden) @ model.out) + model.bias - float(logit)) < 1e-3


def plain_gif(data):
    """The red channels of a file's frames, read code by code: (width, height, delay, samples)."""
    assert data[:6] == b"GIF89a" and data[10] == 0xF7
    palette, at, frames, delay = data[13 : 13 + 768], 13 + 768, [], None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            delay = struct.unpack("<H", data[at + 4 : at + 6])[0]
            at += 8
            continue
        width, height = struct.unpack("<HH", data[at + 5 : at + 9])
        size, at, stream = data[at + 10], at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        bits, pos, clear = int.from_bytes(stream, "little"), 0, 1 << size
        table, out, last, width_now = {}, [], None, size + 1
        while True:
            code = bits >> pos & ((1 << width_now) - 1)
            pos += width_now
            if code == clear:
                table, last, width_now = {k: bytes([k]) for k in range(clear)}, None, size + 1
                continue
            if code == clear + 1:
                break
            entry = table[code] if code in table else last + last[:1]
            if last is not None and len(table) + 2 < 4096:
                table[len(table) + 2] = last + entry[:1]
            if len(table) + 2 == 1 << width_now and width_now < 12:
                width_now += 1
            out.append(entry)
            last = entry
        frames.append((width, height, delay, bytes(palette[3 * k] for k in b"".join(out))))
    return frames


def test_stored_texts_column_by_column(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "é" * 96, "x" * 192, "some words " * 400, "".join(map(chr, rng.integers(32, 0x2FFF, 9000))), "a" * 30_000]
    found = {r.doc_id: r for r in gif.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        raw, r = (text or "").encode(), found[k]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = gif.encode_gif(payload)
        frames = plain_gif(media)
        samples = b"".join(f[3] for f in frames)
        assert samples == payload and all(w * h == len(s) for w, h, _, s in frames)
        counts = np.bincount(np.frombuffer(payload, np.uint8) // 16, minlength=16)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(samples).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == f"frames={len(frames)};ms={sum(10 * f[2] for f in frames)};hist={','.join(map(str, counts))}"


def test_near_copies_of_a_whole_table_equal_all_pairs(spark):
    """Classes of sf0.01 against the similarity of every two texts that share a shingle."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    sets, having = {}, defaultdict(list)
    for key, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = near_dedup._WORD.findall((text or "").lower())
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for s in sets[key]:
            having[s].append(key)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met = {(a, b) for keys in having.values() for i, a in enumerate(keys) for b in keys[i + 1 :]}
    for a, b in met:
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.doc_id: r.class_id for r in catalog.op6_prob_min_hash(spark, SF).collect()}
    assert found == {k: find(k) for k in sets}
