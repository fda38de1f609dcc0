"""GIF round trips and composition, and the classifiers' held-out accuracy."""

import random
import struct

import numpy as np
import pytest

from lacuna.llm import gif, quality, toxicity


def test_samples_round_trip():
    rng = random.Random(1)
    for samples in (bytes(192), bytes(rng.randrange(256) for _ in range(192 * 50)), b"ab" * 96 * 500, bytes(range(192)) * 70, "é text ".encode() * 192):
        media = gif.encode_gif(samples, frame_rows=30)
        back, counts, frames, end = gif.stored_samples(media, len(samples))
        assert back == samples and sum(counts) == len(samples) and frames == -(-len(samples) // (192 * 30)) and end == 100 * frames
    with pytest.raises(ValueError):
        gif.encode_gif(b"x" * 100)


def picture(left, top, w, h, pixels, delay=5, disposal=0, transparent=None, interlaced=False, palette=None):
    packed = disposal << 2 | (transparent is not None)
    local = b"" if palette is None else bytes(palette)
    flags = (0x40 if interlaced else 0) | (0x80 | (len(local) // 3).bit_length() - 2 if local else 0)
    return b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, transparent or 0) + b"\0\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x08" + gif._sub_blocks(gif.lzw_encode(bytes(pixels)))


def file(*parts, width=4, height=4):
    grey = bytes(i for k in range(256) for i in (k,) * 3)
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 9, 0) + grey + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" + b"".join(parts) + b";"


def test_disposal_transparency_palettes_and_interlace():
    data = file(
        picture(0, 0, 4, 4, [1] * 16),
        picture(1, 1, 2, 2, [2, 3, 3, 2], disposal=2, transparent=3),
        picture(0, 0, 1, 1, [5], disposal=3, delay=7),
        picture(3, 3, 1, 1, [1], palette=[0, 0, 0, 200, 100, 50]),
        picture(0, 0, 4, 4, [r for r in (10, 13, 12, 11) for _ in range(4)], interlaced=True),
    )
    frames = list(gif.decode_gif(data))
    red = [f.rgb[..., 0].tolist() for f in frames]
    assert red[1] == [[1, 1, 1, 1], [1, 2, 1, 1], [1, 1, 2, 1], [1, 1, 1, 1]]
    assert red[2] == [[5, 1, 1, 1], [1, 9, 9, 1], [1, 9, 9, 1], [1, 1, 1, 1]]
    assert red[3][0][0] == 1 and frames[3].rgb[3, 3].tolist() == [200, 100, 50]
    assert [row[0] for row in red[4]] == [10, 12, 13, 11]
    assert [(f.start_ms, f.delay_ms) for f in frames] == [(0, 50), (50, 50), (100, 70), (170, 50), (220, 50)]


def test_frames_operator_and_broken_files(spark):
    good = file(picture(0, 0, 4, 4, range(16)))
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:-9]), (6, b"text")]
    found = {r.id: r for r in gif.decode_frames(spark.createDataFrame(rows, "id long, data binary"), "id", "data").collect()}
    assert set(found) == {1, 4, 5, 6} and all(found[k].error and found[k].rgb is None for k in (4, 5, 6))
    assert bytes(found[1].rgb)[::3] == bytes(range(16)) and found[1].hist_red == [16] + [0] * 15


def prose(rng, toxic, poor):
    stems = ["glorp", "snerk"]
    words = [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 200))]
    for _ in range(4 * toxic):
        words[rng.randrange(len(words))] = rng.choice(stems) + "".join(rng.choice("aeiou") for _ in range(4))
    return " ".join(w + "%%%" for w in words) if poor else " ".join(words)


def test_classifiers_hold_on_unseen_texts():
    rng = random.Random(6)
    rows = [(prose(rng, t, p), t, p) for t, p in [(rng.random() < 0.2, rng.random() < 0.3) for _ in range(1200)]]
    fit, rest = rows[:800], rows[800:]
    toxic = toxicity.Scorer(toxicity.train([r[0] for r in fit], np.array([int(r[1]) for r in fit])))
    good = quality.Scorer(quality.train([r[0] for r in fit], np.array([int(not r[2]) for r in fit])))
    texts = [r[0] for r in rest]
    assert np.mean((toxic.scores(texts) >= 0.3) == [r[1] for r in rest]) > 0.97
    assert np.mean((good.scores(texts) >= 0.3) == [not r[2] for r in rest]) > 0.99
    small = toxicity.Scorer(toxic.model, most_words=50, chunk=16)
    assert np.allclose(small.scores(texts[:40]), toxic.scores(texts[:40]))
    assert ((0 <= toxic.scores([None, ""])) & (toxic.scores([None, ""]) < 0.3)).all()


def test_pairs_are_summed_in_linear_time_as_by_definition():
    rng = np.random.default_rng(0)
    model = quality.Model(quality.Config(), np.zeros((15, 11)), 0.1, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    index, value = np.array([1, 5, 7, 19]), np.array([0.5, 1, 2, 1], dtype=np.float32)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(index, value, strict=True)) for b, y in list(zip(index, value, strict=True))[i + 1 :])
    assert abs(quality.machine(model, index, value)[0] - (0.1 + model.weights[index] @ value + pairs)) < 1e-4


def test_one_class_or_no_rows():
    for train, module in ((toxicity.train, toxicity), (quality.train, quality)):
        for texts, labels in (([], []), (["a b"] * 20, [1] * 20), (["a b"] * 20, [0] * 20)):
            scores = module.Scorer(train(texts, np.array(labels, dtype=np.int64))).scores(["a b", None])
            assert ((scores >= 0) & (scores <= 1)).all()
