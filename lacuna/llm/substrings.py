"""Passages that occur in an earlier document, by matching statistics against suffix automata of reference shards.

A window is ``length`` consecutive words of one document. A window's seed is the least hash among its runs of ``seed`` words, so equal windows have equal
seeds wherever they stand. Consecutive windows of a document with one seed are a region. Regions are what is dealt out: the reference shard of a
seed holds the distinct regions that have it, in the order of their first documents, and

1. seeds that occur once in the corpus are dropped by counts alone: their windows have no equal;
2. equal regions of a seed are one, with its first document and its copies; copies in later documents go as a whole;
3. in each shard with more than one region a suffix automaton over words grows document by document. A region is streamed through the automaton of
   all earlier documents' regions; its matching statistics (the longest match that ends at each word) reach ``length`` exactly
   where a window ends that an earlier document has;
4. a shard of more than ``most`` distinct regions is not built: its regions are dealt again by the next, longer seed, as if they were documents, so
   that regions that only touch a frequent passage part from it. The last seed is a whole window, whose shard is one region.

Automata are compared by the words themselves. They are built where their shard's regions are shuffled to rather than broadcast: together they grow with the corpus, and
a broadcast of each to all documents would stream the corpus once for every shard.

Defined results: words are runs of other characters than space and 0x09 to 0x0D; a null text has none. Of rows with equal ids none is earlier; null ids are later than all others
and not earlier than each other. Each row is a document; repeated rows get equal results. Documents of fewer words than a window stay whole. Rows are told apart by id and a 64-bit hash of
the text, equal regions by their seed and another 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.near_dedup import WordHashes, mixed
from lacuna.llm.storage import materialize, scratch

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "array<struct<start: int, n: int>>"


@dataclass(frozen=True)
class Config:
    """``seeds``: the words of a seed, by level; the last is ``length``. ``most``: regions of a shard before it is dealt again."""

    length: int = 50
    seeds: tuple[int, ...] = (16, 50)
    most: int = 512


def words_of(text: str | None) -> list[bytes]:
    """``bytes.split`` without arguments splits at just the white space that is meant."""
    return (text or "").encode("utf-8", "surrogatepass").split()


# ------------------------------------------------------------------------------------ seeds and regions


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, put together from runs of powers of two."""
    out, at, power, part = None, 0, 1, hashes
    n = len(hashes) - size + 1
    while size:
        if size & 1:
            piece = part[at : at + n]
            out = piece if out is None else mixed(out * _MULTIPLIER + piece)
            at += power
        size >>= 1
        if size:
            part = mixed(part[:-power] * _MULTIPLIER + part[power:])
            power *= 2
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def regions(words: list[bytes], hashes: WordHashes, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The regions of a document: seed, a hash of the words, the first window, the number of windows."""
    if len(words) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    least = window_minima(grams(hashes(words), seed), length - seed + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(start, len(least)))
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends])
    same = [xxhash.xxh64_intdigest(text[a:b]) for a, b in zip(begins[start].tolist(), (ends[start + n + length - 2] - 1).tolist(), strict=True)]
    return least[start].view(np.int64), np.array(same, dtype=np.uint64).view(np.int64), start, n


def _lists(parts: list[tuple[np.ndarray, ...]], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """An array of lists of structs from one tuple of arrays for each row."""
    ends = pa.array(np.cumsum([0] + [len(p[0]) for p in parts]), pa.int32())
    fields = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names))


def seeded(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """For rows of (doc, version, text) the document's regions."""
    kind = texts.schema["doc"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                parts = [regions(words_of(t), hashes, length, seed) for t in batch.column("text").to_pylist()]
                lists = _lists(parts, ["seed", "region", "start", "n"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), lists], ["doc", "version", "regions"])

    return texts.select("doc", "version", "text").mapInArrow(found, f"doc {kind}, version long, regions array<struct<seed: long, region: long, start: int, n: int>>")


def cut(texts: DataFrame, length: int) -> DataFrame:
    """For rows of (text, wanted: array of (seed, region, doc, start, n)) the words of each wanted region, joined by one space."""
    kind = texts.schema["wanted"].dataType.elementType

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                wanted, made = batch.column("wanted"), []
                rows = wanted.flatten()
                first, n = rows.field("start").to_pylist(), rows.field("n").to_pylist()
                at = 0
                for text, size in zip(batch.column("text").to_pylist(), wanted.value_lengths().to_pylist(), strict=True):
                    words = words_of(text)
                    made += [b" ".join(words[first[k] : first[k] + n[k] + length - 1]) for k in range(at, at + size)]
                    at += size
                yield pa.RecordBatch.from_arrays([rows.field("seed"), rows.field("region"), rows.field("doc"), pa.array([m.decode("utf-8", "surrogatepass") for m in made], pa.string())], ["seed", "region", "doc", "text"])

    return texts.select("text", "wanted").mapInArrow(parted, f"seed long, region long, doc {kind['doc'].dataType.simpleString()}, text string")


# ------------------------------------------------------------------------------------ suffix automata


class SuffixAutomaton:
    """Of several sequences of words: recognises exactly their consecutive parts."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, state: int, word: bytes, old: int) -> int:
        """A copy of ``old`` for the parts that end at ``state`` and ``word``; longer ones stay with ``old``."""
        nexts, link = self.next, self.link
        new = len(nexts)
        nexts.append(nexts[old].copy())
        link.append(link[old])
        self.length.append(self.length[state] + 1)
        link[old] = new
        while state >= 0 and nexts[state].get(word) == old:
            nexts[state][word] = new
            state = link[state]
        return new

    def add(self, words: list[bytes]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            old = nexts[last].get(word)
            if old is not None:  # known from an earlier sequence
                last = old if length[old] == length[last] + 1 else self._clone(last, word, old)
                continue
            new, state = len(nexts), last
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            while state >= 0 and word not in nexts[state]:
                nexts[state][word] = new
                state = link[state]
            if state >= 0:
                old = nexts[state][word]
                link[new] = old if length[old] == length[state] + 1 else self._clone(state, word, old)
            last = new

    def matches(self, words: list[bytes]) -> list[int]:
        """Matching statistics: for each word the length of the longest known part that ends there."""
        nexts, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for word in words:
            to = nexts[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts[state].get(word)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def spans(sizes: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of windows whose last word has a match of ``length``: first window, number of windows."""
    held = np.concatenate([[False], np.array(sizes[length - 1 :]) >= length, [False]])
    edges = np.flatnonzero(held[1:] != held[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def matched(shards: DataFrame, length: int) -> DataFrame:
    """(seed, region, spans) for rows of (seed, region, doc, text): the windows that a region of an earlier document of its shard has.

    Rows are brought together by seed and sorted by document. A task holds the automaton of one shard; regions wait until a later
    document's comes, so the last one is never added.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed: int | None = None
        doc: str | None = None
        automaton, waiting = SuffixAutomaton(), []
        for batch in batches:
            seeds, contents, found = [], [], []
            for s, r, d, t in zip(*(batch.column(c).to_pylist() for c in ("seed", "region", "name", "text")), strict=True):
                if s != seed:
                    seed, doc, automaton, waiting = s, d, SuffixAutomaton(), []
                elif d != doc:
                    for w in waiting:
                        automaton.add(w)
                    doc, waiting = d, []
                words = words_of(t)
                if len(automaton.next) > 1:
                    at = spans(automaton.matches(words), length)
                    if len(at[0]):
                        seeds.append(s)
                        contents.append(r)
                        found.append(at)
                waiting.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(contents, pa.int64()), _lists(found, ["start", "n"], [pa.int32(), pa.int32()])], ["seed", "region", "spans"])

    # As text, so that a worker can tell one document from the next whatever the type of the id; null stays null and is last.
    named = shards.select("seed", "region", "doc", F.col("doc").cast("string").alias("name"), "text")
    sorted_ = named.repartition("seed").sortWithinPartitions("seed", F.col("doc").asc_nulls_last(), "region")
    return sorted_.mapInArrow(streamed, f"seed long, region long, spans {_SPANS}")


# ------------------------------------------------------------------------------------ levels


def repeated_spans(texts: DataFrame, config: Config, level: int = 0) -> DataFrame:
    """(doc, version, spans) for rows of (doc, version, text): the windows that an earlier document has, as written table."""
    length, seed, last = config.length, config.seeds[level], level + 1 == len(config.seeds)
    with scratch(texts.sparkSession, f"spans-{level}"):
        rows = materialize(seeded(texts, length, seed), "regions").select("doc", "version", F.inline("regions"))
        # Counts are written, so that joins with them have plain exchanges on both sides and adaptive execution splits a frequent seed.
        often = materialize(rows.groupBy("seed").count().where("count > 1").select("seed"), "often")
        rows = materialize(rows.join(often, "seed", "left_semi"), "repeated")
        # Null documents come last, as they do everywhere.
        place = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("version").alias("version"), F.col("start").alias("start"), F.col("n").alias("n"))
        distinct = materialize(rows.groupBy("seed", "region").agg(F.min(place).alias("first")), "distinct")
        sizes = materialize(distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        wanted = distinct.join(sizes, "seed").groupBy("first.doc", "first.version")
        wanted = wanted.agg(F.collect_list(F.struct("seed", "region", F.col("first.doc").alias("doc"), F.col("first.start").alias("start"), F.col("first.n").alias("n"))).alias("wanted"))
        wanted = wanted.select(F.col("doc").alias("of_doc"), F.col("version").alias("of_version"), "wanted")
        # One row of each document is enough to cut from; of repeated rows the regions come twice, and are one again below.
        pieces = materialize(cut(texts.join(wanted, F.col("version").eqNullSafe(F.col("of_version")) & F.col("doc").eqNullSafe(F.col("of_doc"))), length), "pieces")
        pieces = pieces.join(sizes, "seed")
        small, large = pieces if last else pieces.where(F.col("size") <= config.most), pieces.where(F.col("size") > config.most)
        found = matched(small, length)
        if not last and not large.isEmpty():
            version = F.xxhash64("seed", "region").alias("version")
            again = materialize(large.select("seed", "region", "doc", version, "text").dropDuplicates(["seed", "region"]), "large")
            inner = repeated_spans(again.select("doc", "version", "text"), config, level + 1)
            inner = inner.select(F.col("doc").alias("of_doc"), F.col("version").alias("of_version"), "spans")
            found = found.unionByName(again.join(inner, (F.col("version") == F.col("of_version")) & F.col("doc").eqNullSafe(F.col("of_doc"))).select("seed", "region", "spans"))
        # A region that its own document repeats has the same matches in each place; in a later document all its windows go.
        decided = distinct.join(found.groupBy("seed", "region").agg(F.first("spans").alias("spans")), ["seed", "region"], "left").select("seed", "region", F.col("first.none").alias("first_none"), F.col("first.doc").alias("first_doc"), "spans")
        decided = materialize(decided, "decided")
        later = (F.col("first_none") < F.col("doc").isNull()) | (F.col("first_doc") < F.col("doc"))
        moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), s["n"].alias("n")))
        hits = rows.join(decided, ["seed", "region"]).select("doc", "version", F.when(F.coalesce(later, F.lit(False)), F.array(F.struct("start", "n"))).otherwise(moved).alias("spans"))
        hits = hits.where("spans is not null").groupBy("doc", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        return materialize(hits, f"spans-{level}")


def remove_repeats(df: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, n_words, n_removed, kept (the words that stay, joined by one space), spans (removed words: start, n)."""
    if config.seeds[-1] != config.length:
        raise ValueError("the last seed must be a whole window")
    texts = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    with scratch(df.sparkSession, "spans-0"):
        found = repeated_spans(texts, config).select(F.col("doc").alias("of_doc"), F.col("version").alias("of_version"), "spans")
    kind = df.schema[id_col].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts_, counts, removed, runs = [], [], [], []
                for text, gone in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    words = words_of(text)
                    out = np.zeros(len(words) + 1, np.int64)
                    for s in gone or ():
                        out[s["start"]] += 1
                        out[s["start"] + s["n"] + config.length - 1] -= 1
                    out = np.concatenate([[False], np.cumsum(out)[:-1] > 0, [False]])
                    edges = np.flatnonzero(out[1:] != out[:-1])
                    begins, ends = edges[::2], edges[1::2]
                    left, at = [], 0
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    texts_.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                    counts.append(len(words))
                    removed.append(len(words) - len(left))
                    runs.append((begins, ends - begins))
                columns = [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts_, pa.string()), _lists(runs, ["start", "n"], [pa.int32(), pa.int32()])]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "kept", "spans"])

    joined = texts.join(found, F.col("version").eqNullSafe(F.col("of_version")) & F.col("doc").eqNullSafe(F.col("of_doc")), "left").select("doc", "text", "spans")
    out = joined.mapInArrow(kept, f"doc {kind}, n_words long, n_removed long, kept string, spans {_SPANS}")
    return out.withColumnRenamed("doc", id_col)
