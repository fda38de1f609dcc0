"""Near duplicates by ProbMinHash, banding and verification.

A text's elements are its distinct word 5-shingles, each with weight 1 however often it occurs, as verification
compares sets. For every element a Poisson process of that rate sends arrivals to random registers; a register
keeps the element that arrives first, and an element stops as soon as its next arrival is later than all
registers' first ones. Two texts agree in a register with the probability Jaccard similarity of their weights,
which with equal weights is the Jaccard similarity of the sets. Registers are grouped into bands; texts that agree in a whole band are
candidates; candidates are verified by the Jaccard similarity of their sets of shingles (0.8 or more).

No pairs are made within a group. Equal texts are one node from the start. Then

1. each node is verified against one leader of its bands, the node that meets most others;
2. the links found give classes; bands whose members are all of one class are done;
3. in the other bands, the members outside the band's largest class are compared by their registers with all
   members of other classes, in blocks of bounded size inside a Python worker; pairs that are likely enough
   are verified there, and a worker returns no more links than connect what is linked in the block.

So all candidates are settled: linked, or of one class already, or verified, or their registers agree so
seldom (under 0.66 of them) that a similarity of 0.8 is ruled out by four standard deviations.
With 26 bands of 5 registers a pair of similarity 0.8 shares no band with a chance of 3 in 100,000.

Verification uses 32-bit hashes of shingles: of a pair, some shingle is mistaken for another with a chance of
|A| |B| / 2^32.

Defined results: words are runs of letters and digits, in lower case. A text of one to four words is one shingle;
a text without words (or null) is in a class of its own. Each row is a document, repeated rows too.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried, fresh
from lacuna.llm.storage import materialize, scratch

_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Config:
    """``estimate`` is the share of agreeing registers below which a pair of a band is not verified."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    estimate: float = 0.66
    block: int = 256

    @property
    def registers(self) -> int:
        return self.bands * self.rows


# ------------------------------------------------------------------------------------ sketches


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, kept from one text to the next up to ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}

    def _add(self, word: str) -> int:
        found = self.known[word] = xxhash.xxh64_intdigest(word)
        return found

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        find, add = self.known.get, self._add
        return np.array([h if (h := find(w)) is not None else add(w) for w in words], dtype=np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a sequence of word hashes."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(size, len(hashes))
    n = len(hashes) - width + 1
    made = np.full(n, np.uint64(width))
    for k in range(width):
        made = made * _MULTIPLIER + hashes[k : k + n]
    return np.unique(mixed(made))


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_owners: int, registers: int, chunk: int = 1 << 17) -> np.ndarray:
    """The element that each register of each owner keeps (n_owners x registers); 0 for owners without elements.

    Elements send their arrivals in rounds, all elements of a chunk at once, until none is left whose next
    arrival could come first in some register of its owner.
    """
    first = np.full(n_owners * registers, np.inf)
    kept = np.zeros(n_owners * registers, dtype=np.uint64)
    last = np.full(n_owners, np.inf)
    for start in range(0, len(element), chunk):
        own, h, w = owner[start : start + chunk], element[start : start + chunk], weight[start : start + chunk]
        at = np.zeros(len(h))
        for k in itertools.count(1):
            draw = mixed(h + np.uint64(k * int(_MULTIPLIER) % 2**64))
            at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w
            alive = at < last[own]
            own, h, w, at, draw = own[alive], h[alive], w[alive], at[alive], draw[alive]
            if not len(h):
                break
            place = own * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
            better = at < first[place]
            place, time, by = place[better], at[better], h[better]
            np.minimum.at(first, place, time)
            won = first[place] == time
            kept[place[won]] = by[won]
            owners = np.unique(own)
            last[owners] = first.reshape(n_owners, registers)[owners].max(axis=1)
    return kept.reshape(n_owners, registers)


def band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    parts = kept.reshape(len(kept), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MULTIPLIER, (len(kept), bands))
    for k in range(rows):
        keys = mixed(keys * _MULTIPLIER + parts[:, :, k])
    return keys.view(np.int64)


def sketches(docs: DataFrame, config: Config) -> DataFrame:
    """For rows of (rid, id, text): content (a digest of the words), bands, low register bytes and shingles.

    Rows without words have null bands.
    """
    carried = Carried(docs, "id")

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            start = 0
            while start < len(batch):
                found, contents, size, stop = [], [], 0, start
                while stop < len(batch) and size < 200_000:
                    words = _WORD.findall((batch["text"].iat[stop] or "").lower())
                    contents.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    found.append(shingles(hashes(words), config.shingle))
                    size += len(found[-1])
                    stop += 1
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                element = np.concatenate(found)
                kept = prob_min_hash(owner, element, np.ones(len(element)), len(found), config.registers)
                keys, low = band_keys(kept, config.bands, config.rows), (kept & np.uint64(255)).astype(np.uint8)
                some = [len(x) > 0 for x in found]
                yield pd.DataFrame({
                    "rid": batch["rid"].iloc[start:stop].to_numpy(),
                    "id": batch["id"].iloc[start:stop].to_numpy(),
                    "version": batch["version"].iloc[start:stop].to_numpy(),
                    "content": contents,
                    "bands": [k if s else None for k, s in zip(keys, some, strict=True)],
                    "low": [k.tobytes() for k in low],
                    "shingles": [np.unique(x.astype(np.uint32)).tobytes() for x in found],
                })
                start = stop

    out = docs.select("rid", carried.sent, "version", "text").mapInPandas(sketched, f"rid long, id {carried.kind}, version long, content binary, bands array<long>, low binary, shingles binary")
    return out.select("rid", carried.back, "version", "content", "bands", "low", "shingles")


# ------------------------------------------------------------------------------------ verification


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets of distinct 32-bit numbers."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    if min(len(x), len(y)) == 0:
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, config: Config) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough. ``sets``: (node, shingles)."""

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [jaccard(x, y) >= config.similarity for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInPandas(similar, "a long, b long")


def _by_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict[str, np.ndarray], list[int], list[int]]]:
    """Sorted batches as (columns, starts, stops) of whole blocks; a block that a batch breaks off waits for the next."""
    rest: pd.DataFrame | None = None
    for batch in itertools.chain(batches, [None]):
        now = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if now is None or not len(now):
            continue
        keys = now[["key", "i", "j"]].to_numpy()
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        if batch is not None:
            last = cuts[-1] if cuts else 0
            rest, now, cuts = now.iloc[last:], now.iloc[:last], cuts[:-1]
        if len(now):
            yield {c: now[c].to_numpy() for c in now.columns}, [0, *cuts], [*cuts, len(now)]


def _likely(rows: dict[str, np.ndarray], start: int, stop: int, config: Config) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(an outlier's row, the rows of its likely partners, their agreement) in one block.

    Partners are of other classes, and the block's band is the first one whose key both have, so that a pair is
    met in one band only. Low bytes cannot tell which that is: registers may agree in them alone.
    """
    rows_of = np.arange(start, stop)
    outlier = rows["outlier"][start:stop].astype(bool)
    out, rest = rows_of[outlier], rows_of[~outlier]
    if not len(out) or not len(rest):
        return
    low = np.frombuffer(b"".join(rows["low"][rest]), dtype=np.uint8).reshape(len(rest), config.registers)
    classes, band = rows["class"][rest], rows["band"][start]
    for k in out:
        same = low == np.frombuffer(rows["low"][k], dtype=np.uint8)
        agree = same.mean(axis=1)
        near = np.flatnonzero((classes != rows["class"][k]) & (agree >= config.estimate))
        if len(near):
            near = near[(np.stack(rows["bands"][rest[near]]) == rows["bands"][k]).argmax(axis=1) == band]
        if len(near):
            yield int(k), rest[near], agree[near]


def block_links(blocks: DataFrame, sets: DataFrame, config: Config) -> DataFrame:
    """Verified links (a, b) that connect the classes within blocks as all verified pairs would.

    ``blocks``: (key, i, j, band, outlier, node, class), where a block (key, i, j) holds some outliers of a band's
    largest class and some of its members, a few hundred rows at most. Blocks are brought together by a
    shuffle and sorted; a worker holds one batch and the block that it breaks off. First, rows without a likely
    partner are dropped by their registers; then the others' shingles are fetched and likely pairs verified, the
    likeliest first. Pairs that are connected within the block by then are passed over, so a block yields no
    more links than it has rows.
    """
    keys = ["key", "i", "j"]
    schema = "key long, i int, j int, band int, outlier boolean, node long, class long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def partnered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, stops in _by_block(batches):
            kept: set[int] = set()
            for start, stop in zip(starts, stops, strict=True):
                for k, near, _ in _likely(rows, start, stop, config):
                    kept.add(k)
                    kept.update(near.tolist())
            at = np.array(sorted(kept), dtype=np.int64)
            yield pd.DataFrame({c: rows[c][at] for c in columns})

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, stops in _by_block(batches):
            links: list[tuple[int, int]] = []
            for start, stop in zip(starts, stops, strict=True):
                pairs = [(-e, k, int(m)) for k, near, agree in _likely(rows, start, stop, config) for m, e in zip(near, agree, strict=True)]
                root: dict[int, int] = {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while (up := root.get(x, x)) != x:
                        root[x] = root.get(up, up)
                        x = up
                    return x

                for _, k, m in sorted(pairs):
                    x, y = find(int(rows["class"][k])), find(int(rows["class"][m]))
                    if x != y and jaccard(rows["shingles"][k], rows["shingles"][m]) >= config.similarity:
                        root[max(x, y)] = min(x, y)
                        links.append((int(rows["node"][k]), int(rows["node"][m])))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    dealt = blocks.join(sets.select("node", "low", "bands"), "node").repartition(*keys).sortWithinPartitions(*keys)
    likely = materialize(dealt.mapInPandas(partnered, schema), "likely-rows")
    dealt = likely.join(sets.select("node", "low", "bands", "shingles"), "node").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(linked, "a long, b long")


# ------------------------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, class) for each node of undirected edges (a, b): the smallest node that it is connected with.

    In each round a node takes the smallest class among its own and its neighbours', and then that class's
    own class, so that long chains shrink by halves. Nodes of high degree are pre-aggregated before the shuffle.
    """
    spark = edges.sparkSession
    with scratch(spark, "components"):
        both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
        first = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("class"))
        state = materialize(first, "classes")
        while True:
            with scratch(spark, "classes"):
                of_neighbour = state.select(F.col("node").alias("b"), F.col("class").alias("next"))
                reached = both.join(of_neighbour, "b").groupBy("a").agg(F.min("next").alias("next")).select(F.col("a").alias("node"), "next")
                lower = materialize(state.join(reached, "node").select("node", "class", F.least("class", "next").alias("next")), "lower")
                jump = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
                state = materialize(lower.join(jump, "next", "left").select("node", F.col("class").alias("before"), F.coalesce("beyond", "next").alias("class")), "classes")
            if state.where("class <> before").isEmpty():
                return materialize(state.select("node", "class"), "components")


# ------------------------------------------------------------------------------------ operator


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) after more links: what they connect is found on classes alone."""
    for end in ("a", "b"):
        of_end = classes.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}"))
        links = links.join(of_end, end, "left").withColumn(end, F.coalesce(f"class_{end}", end)).drop(f"class_{end}")
    merged = components(links).select(F.col("node").alias("class"), F.col("class").alias("into"))
    old = classes.join(merged, "class", "left").select("node", F.coalesce("into", "class").alias("class"))
    new = merged.select(F.col("class").alias("node"), F.col("into").alias("class")).join(classes, "node", "left_anti")
    return materialize(old.union(new), "classes")


def _blocks(held: DataFrame, config: Config) -> DataFrame:
    """The open bands' members in blocks: outliers of the band's largest class against all members."""
    sizes = held.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("size"))
    mains = mains.select("key", F.col("main.class").alias("main"), F.ceil((F.col("size") - F.col("main.n")) / config.block).alias("n_i"), F.ceil(F.col("size") / config.block).alias("n_j"))
    mains = materialize(mains, "band-mains")

    def dealt(n: str) -> Column:
        return F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    rows = held.join(mains, "key")
    outliers = rows.where("class <> main").select("key", dealt("n_i").alias("i"), every("n_j").alias("j"), "band", F.lit(True).alias("outlier"), "node", "class")
    others = rows.select("key", every("n_i").alias("i"), dealt("n_j").alias("j"), "band", F.lit(False).alias("outlier"), "node", "class")
    return outliers.union(others)


def _links(sketch: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """(node, class) of the nodes that have a verified link. ``nodes``: (rid), one row of each content."""
    keys = sketch.where("bands is not null").join(nodes, "rid", "left_semi").select(F.col("rid").alias("node"), F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(keys.join(buckets, "key"), "band-members")
    common = members.groupBy("node").agg(F.sum("size").alias("common"))
    # Merged at every size: what is wanted grows with the corpus, so it must not depend on fitting into a broadcast.
    wanted = common.select(F.col("node").alias("rid")).hint("merge")
    sets = materialize(sketch.select("rid", "shingles", "low", "bands").join(wanted, "rid", "left_semi").withColumnRenamed("rid", "node"), "shingle-sets")

    # A band's leader is the member that meets most others in all its bands: of copies with edits, the text that they come from.
    ranked = members.join(common, "node").select("key", "node", F.struct("common", (-F.col("node")).alias("minus")).alias("rank"))
    ranked = materialize(ranked, "band-ranks")
    leaders = ranked.groupBy("key").agg(F.max("rank").alias("leader"))
    shared = ranked.join(leaders, "key").where("rank < leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    leading = shared.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("best"))
    classes = components(verified(leading.select(F.col("node").alias("a"), (-F.col("best.leader.minus")).alias("b")), sets, config))

    held = members.select("key", "band", "node").join(classes, "node", "left")
    held = materialize(held.select("key", "band", "node", F.coalesce("class", "node").alias("class")), "band-classes")
    open_keys = held.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("key")
    held = materialize(held.join(open_keys, "key", "left_semi"), "open-bands")
    if held.isEmpty():
        return classes
    return _merged(classes, materialize(block_links(_blocks(held, config), sets, config), "links"))


def near_duplicates(df: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, class_id (the smallest id of its class), class_size, kept, and version.

    ``kept`` is true for one row of each class, the one with the smallest id (null ids last). ``version`` is a hash
    of the text, by which rows that share an id can be told apart.
    """
    with scratch(df.sparkSession, "row-classes"):
        docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
        sketch = materialize(sketches(docs, config), "sketches")
        contents = materialize(sketch.where("bands is not null").groupBy("content").agg(F.min("rid").alias("node")), "contents")
        classes = _links(sketch, contents.select(F.col("node").alias("rid")), config)
        worded = sketch.where("bands is not null").select("rid", "id", "version", "content").join(contents, "content").select("rid", "id", "version", "node")
        wordless = sketch.where("bands is null").select("rid", "id", "version", F.col("rid").alias("node"))
        rows = worded.union(wordless).join(classes, "node", "left").select("rid", "id", "version", F.coalesce("class", "node").alias("class"))
        rows = materialize(rows, "row-classes")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = materialize(rows.groupBy("class").agg(least.alias("least"), F.count(F.lit(1)).alias("class_size")), "class-groups")
    out = rows.join(groups, "class")
    return out.select(F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "class_size", (F.col("rid") == F.col("least.rid")).alias("kept"), "version")


def keep_one(df: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns: one of each class of near duplicates.

    Rows are found again by id and text; of repeated rows with the same id and text one stays, any of them if they differ
    in other columns.
    """
    with scratch(df.sparkSession, "near-duplicates"):
        found = materialize(near_duplicates(df, config, id_col, text_col), "near-duplicates")
    key, version, of_text = (fresh(df, name) for name in ("__id", "__version", "__text_version"))
    kept = found.where("kept").select(F.col(id_col).alias(key), F.col("version").alias(version))
    repeated = materialize(found.groupBy(F.col(id_col).alias(key)).count().where("count > 1").select(key), "repeated-ids")
    same = F.col(id_col).eqNullSafe(F.col(key))
    if repeated.isEmpty():
        # Merged at every size: the ids grow with the corpus, so it must not depend on their fitting into a broadcast.
        return df.join(kept.select(key).hint("merge"), same, "left_semi")
    keyed = df.withColumn(of_text, F.xxhash64(F.col(text_col)))
    rows = keyed.join(kept, same & (F.col(of_text) == F.col(version)), "left_semi")
    once = rows.join(repeated, same, "left_anti")
    again = rows.join(repeated, same, "left_semi").dropDuplicates([id_col, of_text])
    return once.unionByName(again).drop(of_text)
