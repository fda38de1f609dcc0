"""Quality scores by a factorisation machine.

The features of a text are its hashed words, structure statistics cut into quantile bins, and metadata
derived from it (its length and its script). The machine is
``w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, and the pairs are summed in linear time as
``1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]``. It is trained in numpy with Adagrad on a bounded
sample of labelled rows. No column but the text is an input.

The executors read the sample's texts whole and send the driver what the machine sees of each: the buckets of its distinct
words, of which there are at most ``Config.buckets``, and its statistics. So no text is too long to learn from.

Scores are calibrated so that the threshold 0.3 is the cut of best balanced accuracy on rows kept out of
the training.

Defined results: a null or empty text is scored by its statistics, all in their lowest bins. A sample of under 50 rows
is too small to split and calibrates on its training rows; of one class alone, every score leans to that class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried
from lacuna.llm.labelled import in_fold, labelled_sample

THRESHOLD = 0.3


@dataclass(frozen=True)
class Config:
    """Sizes of the model and of its training; ``rows_per_class`` bounds the sample."""

    rows_per_class: int = 2000
    buckets: int = 1 << 18
    bins: int = 12
    rank: int = 6
    epochs: int = 6
    rate: float = 0.1
    seed: int = 11
    validation: int = 5  # each fifth row of the sample calibrates and does not train


#: Classes of bytes: other, space, line feed, digit, lower case, upper case, end of sentence, bar, other sign, part of a longer character.
N_CLASSES = 10
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"", b" \t\r\v\f", b"\n", b"0123456789", bytes(range(97, 123)), bytes(range(65, 91)), b".!?", b"|", b"", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _k
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 0]] = 8

STATISTICS = ("bytes", "words", "lines", "wide", "upper", "lower", "digits", "ends", "bars", "signs", "repeats", "distinct", "word_bytes", "line_words", "long_lines")


def statistics(text: str, words: np.ndarray, distinct: int) -> np.ndarray:
    """Structure of a text: lengths, shares of byte classes, repeats. ``words`` holds a number for each word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(_CLASS[raw], minlength=N_CLASSES)
    n, w = max(1, len(raw)), max(1, len(words))
    letters = max(1, counts[4] + counts[5])
    lines = counts[2] + 1
    repeats = (words[1:] == words[:-1]).sum()
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(lines), counts[9] / n, counts[5] / letters, counts[4] / n, counts[3] / n, counts[6] / w, counts[7] / w,
        counts[8] / w, repeats / w, distinct / w, len(raw) / w, len(words) / lines, (len(raw) / lines) > 2000,
    ])


class Words:
    """Buckets of words, kept from one text to the next up to ``most`` words."""

    def __init__(self, buckets: int, most: int = 200_000):
        self.buckets, self.most, self.known = buckets, most, {}

    def _add(self, word: str) -> int:
        bucket = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % self.buckets
        self.known[word] = bucket
        return bucket

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        find, add = self.known.get, self._add
        return np.array([b if (b := find(w)) is not None else add(w) for w in text.split()], dtype=np.int64)


@dataclass
class Model:
    """Trained parameters; words' buckets come first, then the bins of each statistic."""

    config: Config
    edges: np.ndarray  # statistics x (bins - 1)
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    shift: float = 0.0


def observe(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """What the machine sees of a text: the buckets of its distinct words, and its statistics."""
    found = words(text)
    distinct = np.unique(found)
    return distinct, statistics(text, found, len(distinct))


def features(model: Model, distinct: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices and values of an observed text's features: distinct words share a unit norm, bins count one."""
    bins = (stats[:, None] > model.edges).sum(axis=1) + np.arange(len(stats)) * model.config.bins + model.config.buckets
    return np.concatenate([distinct, bins]), np.concatenate([np.full(len(distinct), 1 / np.sqrt(max(1, len(distinct)))), np.ones(len(bins))]).astype(np.float32)


def machine(model: Model, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
    """The logit, and the sums of factors that its gradient needs, in time linear in the features."""
    scaled = model.factors[index] * value[:, None]
    sums = scaled.sum(axis=0)
    pairs = 0.5 * float((sums * sums - (scaled * scaled).sum(axis=0)).sum())
    return model.bias + float(model.weights[index] @ value) + pairs, sums


def train(texts: list[str], labels: np.ndarray, config: Config = Config()) -> Model:
    """``learn`` from texts."""
    words = Words(config.buckets)
    return learn([observe(t, words) for t in texts], labels, config)


def learn(seen_texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: Config = Config()) -> Model:
    """Train on observed texts and their 0/1 labels; with rows of one class only, every score leans to that class."""
    rng = np.random.default_rng(config.seed)
    order = rng.permutation(len(seen_texts))
    small = len(seen_texts) < 10 * config.validation
    fit, check = (order, order) if small else (np.array([i for k, i in enumerate(order) if k % config.validation]), order[:: config.validation])
    size = config.buckets + len(STATISTICS) * config.bins
    stats = np.array([seen_texts[i][1] for i in fit]) if len(fit) else np.zeros((1, len(STATISTICS)))
    edges = np.quantile(stats, np.linspace(0, 1, config.bins + 1)[1:-1], axis=0).T
    model = Model(config, edges, 0.0, np.zeros(size, dtype=np.float32), rng.normal(0, 0.02, (size, config.rank)).astype(np.float32))
    rows = {i: features(model, *seen_texts[i]) for i in order}
    seen = np.zeros(size, dtype=np.int64)
    for i in fit:
        seen[rows[i][0]] += 1
    model.factors[seen < 2] = 0  # words that no training row or one has: no part in pairs
    counts = np.bincount(labels[fit], minlength=2) if len(fit) else np.zeros(2, int)
    balance = np.where(counts > 0, counts.sum() / (2 * np.maximum(1, counts)), 1.0)
    w_squares, v_squares, b_square = np.full(size, 1e-2, dtype=np.float32), np.full(size, 1e-2, dtype=np.float32), 1e-2
    for _ in range(config.epochs):
        for i in rng.permutation(fit):
            index, value = rows[i]
            logit, sums = machine(model, index, value)
            error = float((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[i]) * balance[labels[i]])
            used = seen[index] > 1
            index, value = index[used], value[used]
            grad = error * value + 1e-4 * model.weights[index]
            w_squares[index] += grad * grad
            model.weights[index] -= config.rate * grad / np.sqrt(w_squares[index])
            own = model.factors[index]
            v_grad = error * value[:, None] * (sums - own * value[:, None]) + 1e-4 * own
            v_squares[index] += (v_grad * v_grad).mean(axis=1)
            model.factors[index] = own - config.rate * v_grad / np.sqrt(v_squares[index])[:, None]
            b_square += error * error
            model.bias -= config.rate * error / b_square**0.5
    logits = np.array([machine(model, *rows[i])[0] for i in check])
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - _cut(logits, labels[check] if len(check) else labels[:0])
    return model


def _cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit of best balanced accuracy, in the middle of the widest gap of equals; 0 with one class only."""
    good, bad = int(labels.sum()), int((labels == 0).sum())
    if not good or not bad:
        return 0.0
    order = np.argsort(logits, kind="stable")
    ranked = logits[order]
    kept = 1 - np.concatenate([[0], np.cumsum(labels[order])]) / good
    dropped = np.concatenate([[0], np.cumsum(labels[order] == 0)]) / bad
    value = kept + dropped
    lows, highs = np.concatenate([[ranked[0] - 2], ranked]), np.concatenate([ranked, [ranked[-1] + 2]])
    value[lows == highs] = -1
    best = np.flatnonzero(value == value.max())
    k = best[np.argmax(highs[best] - lows[best])]
    return float(lows[k] + highs[k]) / 2


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Words(model.config.buckets)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = np.array([machine(self.model, *features(self.model, *observe(t or "", self.words)))[0] for t in texts])
        return 1 / (1 + np.exp(-np.clip(logits + self.model.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on labelled rows outside the held-out fold (crc32 of the id mod 5 is 0), read whole."""
    sample = labelled_sample(docs, labels, "quality", 5, 0, config.rows_per_class, id_col, text_col)
    carried = Carried(sample, "id")

    def observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(config.buckets)
        for batch in batches:
            seen = [observe(t, words) for t in batch["text"]]
            yield batch[["id", "label"]].assign(words=[d.astype("<i4").tobytes() for d, _ in seen], statistics=[s.tolist() for _, s in seen])

    seen = sample.select(carried.sent, "label", "text").mapInPandas(observed, f"id {carried.kind}, label int, words binary, statistics array<double>")
    rows = seen.select(carried.back, "label", "words", "statistics").toPandas().sort_values("id")
    texts = [(np.frombuffer(w, dtype="<i4").astype(np.int64), np.asarray(s)) for w, s in zip(rows["words"], rows["statistics"], strict=True)]
    return learn(texts, rows["label"].to_numpy(dtype=np.int64), config)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = Carried(docs, id_col)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch[["id", "held_out"]].assign(score=scorer.scores(batch["text"].tolist()))

    narrow = docs.select(carried.sent, in_fold(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    out = narrow.mapInPandas(scored, f"id {carried.kind}, held_out boolean, score double")
    return out.select(carried.back, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))

    return docs.where(scores(F.col(text_col)) >= THRESHOLD)
