"""Importance resampling of documents towards a target corpus, by hashed word runs.

Identical texts are collapsed by grouping the whole text: features are counted once for each distinct text, its counts
are multiplied by how often it occurs, and its weight is joined back to its documents before the noise of each document is added.

A text's features are all runs of 1 to ``longest`` consecutive words; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. A bucket's gain is the logarithm of its share of the target over its share of the corpus, both smoothed by one, in
thousandths rounded down; a text's weight is the sum over its features. The highest sums of weight and Gumbel noise are a sample
without replacement with chances in proportion to exp(weight / 1000).

Only two things reach the driver: one count for each bucket, at most ``buckets`` numbers, and the number of documents. Documents
are ranked by ranges of the score (``operators.ranking``), so no task sorts them all; ties of the score end at the id.

Defined results: letters A to Z are lower-cased, no others; a word is a run of other characters than ASCII ones that are not
digits or letters. Null text has no words. A null id is an empty id for the noise and the last in a tie. Each row is a
document, repeated rows too; rows that repeat an id share its noise and are drawn one by one. Without documents of ``least_words`` nothing is
drawn.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import materialize, scratch
from lacuna.operators.ranking import numbered

#: Bytes as a word's bytes, lower-cased, or as a space. Every byte of a character beyond ASCII belongs to a word.
_WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Config:
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


class _Buckets:
    """The buckets of features, kept from one text to the next up to ``most`` features."""

    def __init__(self, config: Config, most: int = 150_000):
        self.config, self.most, self.known = config, most, {}

    def _add(self, feature: bytes) -> int:
        found = self.known[feature] = zlib.crc32(feature) % self.config.buckets
        return found

    def __call__(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of words, and the buckets of the features with their counts, by bucket."""
        words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        counts = Counter(words)
        for n in range(2, self.config.longest + 1):
            counts.update(b" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
        if len(self.known) > self.most:
            self.known = {}
        find, add = self.known.get, self._add
        at = np.array([b if (b := find(f)) is not None else add(f) for f in counts], dtype=np.int64)
        held, place = np.unique(at, return_inverse=True)
        return len(words), held, np.bincount(place, weights=list(counts.values()), minlength=len(held)).astype(np.int64)


def text_features(texts: DataFrame, config: Config) -> DataFrame:
    """For rows of (key, copies, text): key, copies, n_words, buckets, counts."""
    kind = texts.schema["key"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Buckets(config)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [features(t or "") for t in batch.column("text").to_pylist()]
                ends = pa.array(np.cumsum([0] + [len(b) for _, b, _ in found]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]), t)) for k, t in ((1, pa.int32()), (2, pa.int64()))]
                columns = [batch.column("key"), batch.column("copies"), pa.array([n for n, _, _ in found], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "copies", "n_words", "buckets", "counts"])

    return texts.select("key", "copies", "text").mapInArrow(counted, f"key {kind}, copies long, n_words long, buckets array<int>, counts array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts, and the lengths of the rows' lists."""
    lists = batch.column("buckets")
    return lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), lists.value_lengths().to_numpy()


def bucket_counts(features: DataFrame, config: Config) -> np.ndarray:
    """How often the features of each bucket occur in all rows, copies counted. A task adds up its own rows first."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            buckets, counts, lengths = _flat(batch)
            np.add.at(total, buckets, counts * np.repeat(batch.column("copies").to_numpy(), lengths))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    parts = features.select("copies", "buckets", "counts").mapInArrow(added, "bucket int, n long")
    total = np.zeros(config.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from its counts in the corpus and in the target."""
    n = len(source)
    over, under = (target + 1.0) * float(source.sum() + n), (source + 1.0) * float(target.sum() + n)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def text_weights(features: DataFrame, gain: np.ndarray, config: Config) -> DataFrame:
    """For rows of text_features: key, n_words, n_features, weight."""
    kind = features.schema["key"].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts, lengths = _flat(batch)
            ends = np.cumsum(lengths)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counts, gain[buckets] * counts)]
            n_features, weight = (pa.array(s[ends] - s[ends - lengths], pa.int64()) for s in sums)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), n_features, weight], ["key", "n_words", "n_features", "weight"])

    return features.select("key", "n_words", "buckets", "counts").mapInArrow(weighed, f"key {kind}, n_words long, n_features long, weight long")


def _collapsed(df: DataFrame, text_col: str) -> DataFrame:
    """A row for each distinct text: its digest as key, how many rows have it, the text."""
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(_digest(F.col("text")).alias("key"), "copies", "text")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def resample(df: DataFrame, target: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row per document: the id, n_features, weight, score, and rank (1 is the highest score; null where not drawn)."""
    with scratch(df.sparkSession, "scores", "ranges"):
        features = materialize(text_features(_collapsed(df, text_col), config), "text-features")
        aim = text_features(_collapsed(target, target_col), config)
        gain = gains(bucket_counts(features, config), bucket_counts(aim, config))
        weights = text_weights(features, gain, config)
        noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        docs = df.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("key"))
        # Plain exchanges on both sides, so that adaptive execution splits the partition of a text with very many copies.
        scored = docs.join(weights, "key").select("id", "n_words", "n_features", "weight", (F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))).alias("score"))
        scored = materialize(scored, "scores")
        able = scored.where(F.col("n_words") >= config.least_words)
        drawn = config.percent * able.count() // 100
        ranked = numbered(able, [F.desc("score"), F.col("id").asc_nulls_last()], name="rank")
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.where(F.col("n_words") < config.least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
