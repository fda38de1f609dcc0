"""Toxicity by a convolutional text classifier written in numpy.

Words become embeddings that are sums of hashed pieces: the word itself and its beginnings of three to seven
letters, so that inflected and compounded forms share what they have in common. Filters of several
widths run over the words of the whole text, their largest responses are pooled, and a logistic layer gives
the logit. Embeddings, filters and output layer are trained together with Adagrad on all labelled rows;
the first embedding column starts as the pieces' log-odds, counted over all rows that train.

Training reads every row in each epoch. The rows are dealt by a hash of their id to shards of bounded size; in an epoch
each shard trains by mini-batches from the same parameters, and the next epoch starts from the shards' mean, a piece's
from the mean of the shards that changed it. Changes are added as integers, so the model depends neither on the
partitions nor on the order of tasks.

Thresholds are calibrated by language on the fifth of the labelled rows that does not train: for each language, guessed from
the text's function words, the logit is shifted so that the threshold of best F1 lies at the score 0.3. All these rows
count, by thousandths of a logit. Neither the language column nor any other column but the text is an input.

Defined results: a null or empty text has the score of no words, a constant below the threshold. Under 50 labelled
rows are too few to split and calibrate as they train; without rows of both classes nothing is trained.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried
from lacuna.llm.labelled import in_fold, labelled_rows
from lacuna.llm.memory import giving_back, small_batches
from lacuna.llm.storage import materialize, scratch

THRESHOLD = 0.3
LANGUAGES = ("en", "de", "fr", "es")
# Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to that is was for with it on as are by this be from an at in",
    "de": "der die und das den von zu mit sich des ist im dem nicht ein eine als auch auf für",
    "fr": "le la les de des et un une du est que qui dans pour sur pas au avec par elle",
    "es": "el la los las de que y en un una del se por con no su para al lo como",
}
_WORD = re.compile(r"[^\W\d_]+")
_LOW = -30.0
#: Toxic rows of a language that count as much as all languages' common threshold.
SHRINK = 10


@dataclass(frozen=True)
class Config:
    """Sizes of the model and of its training; a shard is closed at ``shard_words`` words, and its rows go on in another."""

    buckets: int = 1 << 22
    min_docs: int = 3
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    epochs: int = 5
    batch: int = 64
    rate: float = 0.08
    seed: int = 7
    validation: int = 5  # a fifth of the labelled rows calibrates and does not train
    shard_rows: int = 4000  # rows that train in a shard, about
    shard_words: int = 2_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


#: Lengths of a word's beginnings; with the word itself, the most pieces that a word has.
BEGINNINGS = (3, 4, 5, 6, 7)
MOST_PIECES = len(BEGINNINGS) + 1


def piece_hashes(word: str, buckets: int) -> list[int]:
    """Buckets of the word and of its beginnings; the kind of piece is part of what is hashed."""
    return [_bucket(f"{n} {word[:n]}", buckets) for n in BEGINNINGS if len(word) > n] + [_bucket(f"w {word}", buckets)]


def _bucket(piece: str, buckets: int) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % buckets


class Rows:
    """Table rows of sorted buckets, in four bytes a bucket; row 0 is no bucket's."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = array("i", buckets.astype(np.int32).tobytes())

    def get(self, bucket: int, default: int = 0) -> int:
        k = bisect_left(self.buckets, bucket)
        return k + 1 if k < len(self.buckets) and self.buckets[k] == bucket else default

    def __contains__(self, bucket: int) -> bool:
        return self.get(bucket) > 0

    def __len__(self) -> int:
        return len(self.buckets)


_WORD_SEED = zlib.crc32(b"w ")
_SEEDS = [(n, zlib.crc32(f"{n} ".encode())) for n in BEGINNINGS]


def _pieces(words: list[str], buckets: int) -> np.ndarray:
    """The ``piece_hashes`` of many words, a row each, filled up with -1."""
    flat: list[int] = []
    add, crc = flat.append, zlib.crc32
    for word in words:
        whole, length, left = word.encode("utf-8", "surrogatepass"), len(word), len(BEGINNINGS)
        plain = len(whole) == length  # a byte a letter
        for n, seed in _SEEDS:
            if length <= n:
                break
            add(crc(whole[:n] if plain else word[:n].encode("utf-8", "surrogatepass"), seed))
            left -= 1
        add(crc(whole, _WORD_SEED))
        if left:
            flat.extend((-1,) * left)
    pieces = np.array(flat, dtype=np.int64).reshape(-1, MOST_PIECES)
    return np.where(pieces < 0, -1, pieces % buckets)


@dataclass
class Model:
    """Trained parameters. Row 0 of ``table`` is zero and stands for unknown pieces."""

    config: Config
    rows: Mapping[int, int] | Rows
    table: np.ndarray
    kernels: list[np.ndarray]  # one of width x dim x filters for each width
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    shifts: dict[str, float] = field(default_factory=dict)


class Scorer:
    """Scores texts with a model; words' filter responses are kept from one text to the next.

    The kept words are dropped when they are more than ``most_words``, so that memory is bounded.
    """

    def __init__(self, model: Model, most_words: int = 100_000, chunk: int = 1 << 16):
        self.model, self.most_words, self.chunk = model, most_words, chunk
        self.votes = {w: np.array([w in FUNCTION_WORDS[x].split() for x in LANGUAGES], dtype=np.int8) for x in LANGUAGES for w in FUNCTION_WORDS[x].split()}
        self.kernel = np.concatenate([k.transpose(1, 0, 2).reshape(k.shape[1], -1) for k in model.kernels], axis=1)  # dim x all (offset, filter)
        self.row_of = np.zeros(model.config.buckets + 1, dtype=np.int32)
        buckets, rows = (model.rows.buckets, np.arange(1, len(model.rows) + 1)) if isinstance(model.rows, Rows) else (list(model.rows), list(model.rows.values()))
        self.row_of[np.array(buckets, dtype=np.int64)] = rows
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.responses = np.zeros((1024, self.kernel.shape[1]), dtype=np.float32)  # row 0: no word
        self.language = np.zeros((1024, len(LANGUAGES)), dtype=np.int8)

    def _add(self, words: set[str]) -> None:
        """Compute the responses of new words together, each by the same sums whatever the others are."""
        new = list(words)
        pieces = self.row_of[_pieces(new, self.model.config.buckets)]  # -1: the last, no bucket
        start, stop = len(self.ids) + 1, len(self.ids) + 1 + len(new)
        while stop > len(self.responses):
            self.responses = np.concatenate([self.responses, np.zeros_like(self.responses)])
            self.language = np.concatenate([self.language, np.zeros_like(self.language)])
        self.responses[start:stop] = np.einsum("wd,dk->wk", self.model.table[pieces].sum(axis=1), self.kernel)
        for row, word in enumerate(new, start):
            self.ids[word] = row
            self.language[row] = self.votes.get(word, 0)

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Uncalibrated logits, and the guessed languages ("" where no function word is found)."""
        model, n_filters = self.model, self.model.config.filters
        reach = max(model.config.widths)
        pooled = np.full((len(texts), n_filters * len(model.config.widths)), _LOW, dtype=np.float32)
        votes = np.zeros((len(texts), len(LANGUAGES)), dtype=np.int64)
        for k, text in enumerate(texts):
            if len(self.ids) > self.most_words:
                self._reset()
            words = words_of(text)
            if new := {w for w in words if w not in self.ids}:
                self._add(new)
            ids = np.array([*map(self.ids.__getitem__, words), *[0] * (reach - 1)], dtype=np.int64)
            if len(ids) < reach:
                continue
            for start in range(0, len(ids) - reach + 1, self.chunk):
                part = ids[start : start + self.chunk + reach - 1]
                votes[k] += self.language[part[: self.chunk]].sum(axis=0, dtype=np.int64)
                found = self.responses[part]
                n, at = len(part) - reach + 1, 0
                for j, width in enumerate(model.config.widths):
                    z = found[:n, at : at + n_filters]
                    for o in range(1, width):
                        z = z + found[o : o + n, at + o * n_filters : at + (o + 1) * n_filters]
                    at += width * n_filters
                    into = pooled[k, j * n_filters : (j + 1) * n_filters]
                    np.maximum(into, z.max(axis=0), out=into)
        hidden = np.maximum(pooled + np.concatenate(model.biases), 0)
        best = votes.argmax(axis=1)
        return hidden @ model.out + model.bias, [LANGUAGES[b] if v[b] else "" for b, v in zip(best, votes, strict=True)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores between 0 and 1; 0.3 is each language's threshold."""
        logits, languages = self.logits(texts)
        shift = np.array([self.model.shifts.get(x, self.model.shifts.get("", 0.0)) for x in languages])
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64) + shift, -40, 40)))


class Vocabulary:
    """Numbers of words in the order they are met, and the buckets of their pieces; -1 fills rows up."""

    def __init__(self, buckets: int):
        self.buckets, self.numbers = buckets, {}
        self.pieces = np.full((1024, MOST_PIECES), -1, dtype=np.int32)

    def read(self, text: str) -> np.ndarray:
        """The numbers of the text's words; unknown ones are added."""
        words, numbers = words_of(text), self.numbers
        if new := list(dict.fromkeys(w for w in words if w not in numbers)):
            start, stop = len(numbers), len(numbers) + len(new)
            while stop > len(self.pieces):
                self.pieces = np.concatenate([self.pieces, np.full_like(self.pieces, -1)])
            self.pieces[start:stop] = _pieces(new, self.buckets)
            numbers.update(zip(new, range(start, stop), strict=True))
        return np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))


def _add_counts(counts: np.ndarray, texts: list[str], labels: list[int], vocabulary: Vocabulary) -> None:
    """Add to ``counts``, a row for each class and a column for each bucket, the texts that have a piece."""
    for text, label in zip(texts, labels, strict=True):
        words = vocabulary.read(text)
        pieces = vocabulary.pieces[words]
        counts[label, pieces[pieces >= 0]] += 1  # once, however often an index is repeated


@dataclass
class Shard:
    """Rows in the form that training reads: all word numbers, where each row's end, and the table rows of words' pieces."""

    labels: np.ndarray
    words: np.ndarray
    ends: np.ndarray
    pieces: np.ndarray


def _shards(rows: Iterator[tuple[str, int]], known: np.ndarray, config: Config) -> Iterator[Shard]:
    """The rows in their order, in shards of at most ``shard_words`` words or one row; ``known`` are the table's buckets."""

    def closed() -> Shard:
        hashed = vocabulary.pieces[: len(vocabulary.numbers)]
        at = np.searchsorted(known, hashed)
        found = np.append(known, -2)[at] == hashed
        return Shard(np.array(labels, dtype=np.int64), np.concatenate(words), np.cumsum([len(w) for w in words]), np.where(found, at + 1, 0).astype(np.int32))

    vocabulary, labels, words, held = Vocabulary(config.buckets), [], [], 0
    for text, label in rows:
        own = vocabulary.read(text)
        words.append(own)
        labels.append(label)
        held += len(own)
        if held >= config.shard_words:
            yield closed()
            vocabulary, labels, words, held = Vocabulary(config.buckets), [], [], 0
    if labels:
        yield closed()


@dataclass
class Training:
    """A model and the sums of squared gradients that Adagrad keeps for it."""

    model: Model
    class_weight: np.ndarray
    squares: list[np.ndarray]
    table_squares: np.ndarray
    bias_square: float = 1e-3

    def copy(self) -> Training:
        m = self.model
        model = replace(m, table=m.table.copy(), kernels=[k.copy() for k in m.kernels], biases=[b.copy() for b in m.biases], out=m.out.copy())
        return replace(self, model=model, squares=[s.copy() for s in self.squares], table_squares=self.table_squares.copy())

    def part(self, rows: np.ndarray) -> Training:
        """The same training with these rows of the table alone, which share no memory with it."""
        return replace(self, model=replace(self.model, table=self.model.table[rows]), table_squares=self.table_squares[rows])

    def params(self) -> list[np.ndarray]:
        return [*self.model.kernels, *self.model.biases, self.model.out]

    def dense(self) -> np.ndarray:
        """All but the table in one vector."""
        return np.concatenate([*(p.ravel() for p in self.params()), *(s.ravel() for s in self.squares), [self.model.bias, self.bias_square]]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for into in (*self.params(), *self.squares):
            into[...] = values[at : at + into.size].reshape(into.shape)
            at += into.size
        self.model.bias, self.bias_square = map(float, values[at:])


def _start(known: np.ndarray, no: np.ndarray, yes: np.ndarray, n_of: list[int], config: Config) -> Training:
    """The untrained model: sorted buckets, the rows of either class that have them, and the rows of either class."""
    rng = np.random.default_rng(config.seed)
    table = rng.normal(0, 0.05, (len(known) + 1, config.dim)).astype(np.float32)
    table[0] = 0
    odds = np.log((yes + 0.5) / (max(1, n_of[1]) + 1)) - np.log((no + 0.5) / (max(1, n_of[0]) + 1))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    table[1:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * error)
    kernels = [rng.normal(0, 0.3, (w, config.dim, config.filters)).astype(np.float32) for w in config.widths]
    for kernel in kernels:
        kernel[0, :, 0] = np.eye(config.dim)[0]
    biases = [np.zeros(config.filters, dtype=np.float32) for _ in config.widths]
    out = rng.normal(0, 0.1, config.filters * len(config.widths)).astype(np.float32)
    out[:: config.filters] = 0.5
    model = Model(config, Rows(known), table, kernels, biases, out, -2.0)
    class_weight = np.array([1.0, max(1.0, n_of[0] / max(1, n_of[1]))]) ** 0.5
    return Training(model, class_weight, [np.full_like(p, 1e-3) for p in (*kernels, *biases, out)], np.full(len(table), 1e-3, dtype=np.float32))


#: Changes are added as integers of this unit, which have the same sum in any order.
UNIT = 2.0**-30


def _changes(base: Training, shard: Shard, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What one epoch over a shard changes: keys, and a vector of dim + 1 integers for each.

    A key is a table row (its embedding and its sum of squares), or -1 - k for part k of all other parameters.
    """
    used = np.zeros(len(base.table_squares), dtype=bool)
    used[shard.pieces] = True
    used[0] = True  # row 0 stays the first
    used = np.flatnonzero(used)
    pieces, base = np.searchsorted(used, shard.pieces).astype(np.int32), base.part(used)
    t, c = base.copy(), base.model.config
    order = np.random.default_rng(seed).permutation(len(shard.labels))
    starts = np.concatenate([[0], shard.ends[:-1]])
    changed = np.zeros(len(t.table_squares), dtype=bool)
    for start in range(0, len(order), c.batch):
        batch = order[start : start + c.batch]
        _step(t, [shard.words[starts[i] : shard.ends[i]] for i in batch], shard.labels[batch], pieces, changed)
    rows = np.flatnonzero(changed)
    table = np.concatenate([t.model.table[rows] - base.model.table[rows], (t.table_squares[rows] - base.table_squares[rows])[:, None]], axis=1, dtype=np.float64)
    rest = t.dense() - base.dense()
    rest = np.concatenate([rest, np.zeros(-len(rest) % (c.dim + 1))]).reshape(-1, c.dim + 1)
    return np.concatenate([used[rows], -1 - np.arange(len(rest))]), np.rint(np.concatenate([table, rest]) / UNIT).astype(np.int64)


def _apply(t: Training, keys: np.ndarray, sums: np.ndarray, shards: np.ndarray) -> None:
    """Add the mean of the changes, given their sums and the number of shards that have the key."""
    mean = sums * UNIT / shards[:, None]
    of_table, rest = keys >= 0, np.flatnonzero(keys < 0)
    t.model.table[keys[of_table]] += mean[of_table, :-1].astype(np.float32)
    t.table_squares[keys[of_table]] += mean[of_table, -1].astype(np.float32)
    dense = t.dense()
    t.set_dense(dense + mean[rest[np.argsort(-keys[rest])]].ravel()[: len(dense)])


def _step(t: Training, docs: list[np.ndarray], y: np.ndarray, pieces: np.ndarray, changed: np.ndarray, chunk: int = 1 << 16) -> None:
    """Adagrad on a mini-batch; through the pooling only the strongest position of each filter learns."""
    model, c = t.model, t.model.config
    reach, f = max(c.widths), c.filters
    used = np.zeros(len(pieces), dtype=bool)
    for doc in docs:
        used[doc] = True
    distinct = np.flatnonzero(used)
    number = np.zeros(len(pieces), dtype=np.int32)
    number[distinct] = np.arange(1, len(distinct) + 1)  # 0: no word
    x = np.concatenate([np.zeros((1, c.dim), dtype=np.float32), model.table[pieces[distinct]].sum(axis=1)])
    responses = x @ np.concatenate([k.transpose(1, 0, 2).reshape(c.dim, -1) for k in model.kernels], axis=1)
    pooled = np.full((len(docs), f * len(c.widths)), _LOW, dtype=np.float32)
    strongest = [np.zeros((w, len(docs), f), dtype=np.int32) for w in c.widths]  # the words under each filter there
    filters = np.arange(f)
    for k, doc in enumerate(docs):
        ids = np.concatenate([number[doc], np.zeros(reach - 1, dtype=np.int32)])
        for start in range(0, len(doc), chunk):
            part = ids[start : start + chunk + reach - 1]
            found, n, at = responses[part], len(part) - reach + 1, 0
            for j, width in enumerate(c.widths):
                z = found[:n, at : at + f]
                for o in range(1, width):
                    z = z + found[o : o + n, at + o * f : at + (o + 1) * f]
                at += width * f
                place = z.argmax(axis=0)
                value, into = z[place, filters], pooled[k, j * f : (j + 1) * f]
                more = value > into
                into[more] = value[more]
                for o in range(width):
                    strongest[j][o, k, more] = part[place[more] + o]
    raw = pooled + np.concatenate(model.biases)
    hidden = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.bias, -30, 30)))
    error = ((p - y) * t.class_weight[y] / len(docs)).astype(np.float32)
    back = error[:, None] * model.out * (raw > 0)
    x_grad = np.zeros_like(x)
    kernel_grads = []
    for j, kernel in enumerate(model.kernels):
        g = back[:, j * f : (j + 1) * f]
        kernel_grad = np.zeros_like(kernel)
        for o in range(len(kernel)):
            kernel_grad[o] = np.einsum("kfd,kf->df", x[strongest[j][o]], g)
            np.add.at(x_grad, strongest[j][o].ravel(), (g[:, :, None] * kernel[o].T[None]).reshape(-1, c.dim))
        kernel_grads.append(kernel_grad)
    grads = [*kernel_grads, *[back[:, j * f : (j + 1) * f].sum(axis=0) for j in range(len(c.widths))], hidden.T @ error + 1e-4 * model.out]
    for param, grad, square in zip(t.params(), grads, t.squares, strict=True):
        square += grad * grad
        param -= c.rate * grad / np.sqrt(square)
    t.bias_square += float(error.sum()) ** 2
    model.bias -= c.rate * float(error.sum()) / t.bias_square**0.5
    touched = np.flatnonzero(np.abs(x_grad[1:]).sum(axis=1))
    if len(touched):
        piece = pieces[distinct[touched]]
        unique, where = np.unique(piece, return_inverse=True)
        total = np.zeros((len(unique), c.dim), dtype=np.float32)
        np.add.at(total, where.ravel(), np.repeat(x_grad[1:][touched], piece.shape[1], axis=0))
        total[unique == 0] = 0  # row 0 stays zero
        t.table_squares[unique] += (total * total).mean(axis=1)
        model.table[unique] -= c.rate * total / np.sqrt(t.table_squares[unique])[:, None]
        changed[unique[unique > 0]] = True


def _best_threshold(values: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> float | None:
    """The middle of the widest gap between neighbours that gives the best F1, or None without rows of both classes.

    ``values`` are distinct logits from the greatest on, with their rows and the toxic ones among them.
    """
    if not hits.sum() or hits.sum() == rows.sum():
        return None
    f1 = 2 * np.cumsum(hits) / (np.cumsum(rows) + hits.sum())
    gaps = np.concatenate([values[:-1] - values[1:], [2.0]])
    best = np.flatnonzero(f1 == f1.max())
    k = int(best[gaps[best].argmax()])
    return float(values[k] - gaps[k] / 2)


#: Logits are counted by this unit where thresholds are sought.
LOGIT_UNIT = 0.001


def _units(logits: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logits, -1000, 1000) / LOGIT_UNIT).astype(np.int64)


def _shifts(counts: pd.DataFrame) -> dict[str, float]:
    """What to add to logits, by language and ("") elsewhere, so that the thresholds lie at 0.3.

    ``counts`` has the rows and the toxic ones among them (``hits``) of each ``language`` and unit of logits.
    """
    target = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    if not len(counts):
        return {"": target - 1}

    def sought(part: pd.DataFrame) -> tuple[float | None, float]:
        by_unit = part.groupby("unit")[["rows", "hits"]].sum().sort_index(ascending=False)
        n = int(by_unit["hits"].sum())
        # Few toxic rows say little about their own threshold.
        return _best_threshold(by_unit.index.to_numpy() * LOGIT_UNIT, by_unit["rows"].to_numpy(), by_unit["hits"].to_numpy()), n / (n + SHRINK)

    found, trust = sought(counts)
    overall = 0.0 if found is None else float(trust * found)  # the logit of an even chance counts for the rest
    shifts = {"": target - overall}
    for x in LANGUAGES:
        found, trust = sought(counts[counts["language"] == x])
        shifts[x] = target - (overall if found is None else float(trust * found + (1 - trust) * overall))
    return shifts


def train(texts: list[str], labels: np.ndarray, config: Config = Config()) -> Model:
    """Train in memory on texts and their 0/1 labels; with no row of one class every score is a constant."""
    order = np.random.default_rng(config.seed).permutation(len(texts))
    fit, check = (order, order) if len(texts) < 10 * config.validation else (np.array([i for k, i in enumerate(order) if k % config.validation]), order[:: config.validation])
    counts = np.zeros((2, config.buckets), dtype=np.int32)
    _add_counts(counts, [texts[i] for i in fit], [int(labels[i]) for i in fit], Vocabulary(config.buckets))
    known = np.flatnonzero(counts.sum(axis=0) >= config.min_docs)
    n_of = [sum(int(labels[i]) == c for i in fit) for c in (0, 1)]
    t = _start(known, *counts[:, known], n_of, config)
    if all(n_of):
        parts = -(-len(fit) // config.shard_rows)
        shards = [s for k in range(parts) for s in _shards(((texts[i], int(labels[i])) for i in fit[k::parts]), known, config)]
        for epoch in range(config.epochs):
            found = [_changes(t, s, [config.seed, epoch, k]) for k, s in enumerate(shards)]
            keys, where, n = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True, return_counts=True)
            sums = np.zeros((len(keys), config.dim + 1), dtype=np.int64)
            np.add.at(sums, where, np.concatenate([v for _, v in found]))
            _apply(t, keys, sums, n)
    logits, languages = Scorer(t.model).logits([texts[i] for i in check])
    t.model.shifts = _shifts(pd.DataFrame({"language": languages, "unit": _units(logits), "rows": 1, "hits": labels[check] if len(check) else labels[:0]}))
    return t.model


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on every labelled row outside the held-out fold (crc32 of the id mod 4 is 2), with its whole text.

    The rows and their shards are staged. The driver holds the model, the buckets' counts and the sums of an epoch's
    changes, all bounded by ``buckets``; a task holds the model, a shard and the rows of the table that the shard uses.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    with scratch(spark):
        rows = labelled_rows(docs, labels, "toxic", 4, 2, id_col, text_col).withColumn("order", F.xxhash64("id", F.lit(config.seed)))
        rows = materialize(rows, "toxicity-rows")
        n = rows.count()
        small = F.lit(n < 10 * config.validation)
        own = F.pmod("order", F.lit(config.validation)) == 0
        learning, checking = rows.where(small | ~own), rows.where(small | own)
        n_by_label = dict(learning.groupBy("label").count().collect())
        n_of = [n_by_label.get(c, 0) for c in (0, 1)]
        t = _start(*_counted(learning, config), n_of, config)
        if all(n_of):
            shards = _staged(learning, sum(n_of), t, config)
            for epoch in range(config.epochs):
                _apply(t, *_epoch(shards, t, epoch))
        t.model.shifts = _shifts(_calibration(checking, t.model))
    return t.model


def _counted(rows: DataFrame, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that enough rows have, and how many rows of either class have them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, vocabulary = np.zeros((2, config.buckets), dtype=np.int32), Vocabulary(config.buckets)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                if len(vocabulary.numbers) > 200_000:
                    vocabulary = Vocabulary(config.buckets)
                _add_counts(counts, [text], [label], vocabulary)
        found = np.flatnonzero(counts.any(axis=0))
        for start in range(0, len(found), 1 << 18):
            part = found[start : start + (1 << 18)]
            yield pd.DataFrame({"bucket": part.astype(np.int32), "no": counts[0, part], "yes": counts[1, part]})

    found = rows.select("text", "label").mapInPandas(giving_back(counted), "bucket int, no int, yes int")
    found = found.groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).where(F.col("no") + F.col("yes") >= config.min_docs)
    known, no, yes = (c.to_numpy() for c in found.toArrow().columns)
    order = np.argsort(known)
    return known[order], no[order], yes[order]


def _staged(rows: DataFrame, n: int, t: Training, config: Config) -> DataFrame:
    """The shards as a written table: the number, the part of a long one, and the pickled shard, packed, with its size before.

    A task makes one shard. Packed, it is about half as large in the buffers through which the JVM passes it in each epoch.
    """
    known = rows.sparkSession.sparkContext.broadcast(np.array(t.model.rows.buckets, dtype=np.int32))
    parts = -(-n // config.shard_rows)

    def staged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows_of(number: int) -> Iterator[tuple[str, int]]:
            nonlocal row
            while row is not None and row[0] == number:
                yield row[1], row[2]
                row = next(following, None)

        following = (r for b in batches for r in zip(b["number"], b["text"], b["label"], strict=True))
        row = next(following, None)
        while row is not None:
            number = row[0]
            for part, shard in enumerate(_shards(rows_of(number), known.value, config)):
                held = pickle.dumps(shard, protocol=5)
                yield pd.DataFrame({"number": [number], "part": [part], "size": [len(held)], "shard": [pa.compress(held, codec="zstd", asbytes=True)]})

    # The bits of the order that choose the rows for calibration do not choose the shard.
    dealt = rows.select(F.pmod(F.xxhash64("order"), F.lit(parts)).cast("int").alias("number"), "text", "label", "order", "id")
    dealt = dealt.repartitionById(parts, "number").sortWithinPartitions("number", "order", "id").select("number", "text", "label")
    return materialize(dealt.mapInPandas(giving_back(staged), "number int, part int, size long, shard binary"), "toxicity-shards")


#: Changes that a worker sends at once, of 80 bytes each: the JVM holds them beside its heap.
SENT = 1 << 15


def _epoch(shards: DataFrame, t: Training, epoch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that an epoch changes, the sums of their changes, and the number of shards that have them."""
    shared, names = shards.sparkSession.sparkContext.broadcast(t), [f"d{k}" for k in range(t.model.config.dim + 1)]

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            for number, part, size, shard in zip(batch["number"], batch["part"], batch["size"], batch["shard"], strict=True):
                held = pickle.loads(pa.decompress(shard.as_buffer(), size.as_py(), codec="zstd"))
                keys, values = _changes(base, held, [base.model.config.seed, epoch, number.as_py(), part.as_py()])
                for at in range(0, len(keys), SENT):
                    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in values[at : at + SENT].T), pa.array(keys[at : at + SENT])], [*names, "key"])

    found = shards.mapInArrow(giving_back(changes), ", ".join(f"{d} long" for d in names) + ", key long")
    found = found.groupBy("key").agg(*[F.sum(d).alias(d) for d in names], F.count(F.lit(1)).alias("shards")).toArrow()
    shared.unpersist()
    return found["key"].to_numpy(), np.column_stack([found[d].to_numpy() for d in names]), found["shards"].to_numpy()


def _calibration(rows: DataFrame, model: Model) -> pd.DataFrame:
    """Counts of rows and toxic rows by guessed language and unit of the logit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            logits, languages = scorer.logits(batch["text"].tolist())
            yield pd.DataFrame({"language": languages, "unit": _units(logits), "label": batch["label"].to_numpy()})

    found = rows.select("text", "label").mapInPandas(giving_back(scored), "language string, unit long, label int")
    found = found.groupBy("language", "unit").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("hits")).toArrow().to_pandas()
    shared.unpersist()
    return found


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = Carried(docs, id_col)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch[["id", "held_out"]].assign(score=scorer.scores(batch["text"].tolist()))

    narrow = docs.select(carried.sent, in_fold(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    out = narrow.mapInPandas(giving_back(scored), f"id {carried.kind}, held_out boolean, score double")
    return out.select(carried.back, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @giving_back
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))

    return docs.where(scores(F.col(text_col)) < THRESHOLD)
