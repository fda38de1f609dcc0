"""Hard negatives by distributed radix selection.

Each anchor has a window of scores (and a side: rows of its label, or of others), in which the ``k`` first rows by (score
descending, id ascending, row) are wanted. Each block of anchors meets each slice of the rows; a task holds the anchors, streams the rows past them and returns, for
each window, one histogram of a digit of the rows' keys: of the score while it is open, then of the id among equal scores, then of
the row among equal ids. The histograms are summed, the digit that holds the kth row is found, and the next round looks at
the next digit of rows with that digit only. A window is decided as soon as at most ``gather`` of its rows come up to the digit
found; then only those rows are gathered and numbered. No list of scores is kept or moved, ties cost rounds, not rows, and nothing
about anchors or rows passes through the driver but two counts and four bounds.

The anchors are a stated set of queries against all rows. A row is shuffled once for each block of ``anchors`` anchors in a round, an anchor once for
each slice, of which there are ``slices`` or as many as have ``slice_rows`` rows. A task's memory is a block, its histograms and one batch of rows, whatever the labels or the ties; histograms are as many as windows and slices.

Defined results: components become floor(scale * x), x as double. Rows with a null id, label or vector, without components, or with a
component that is null or not finite, or 2^26 or more after scaling, take no part; scores are exact integers below 2^63 for vectors of up to 2,048
such components. Rows whose vectors differ in length have no score. Each row counts, repeated rows too: a row is not its own
positive, but a copy of it is a row like others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.storage import materialize, scratch

#: A window: rows of ``same`` label (or others) with ``low`` <= score <= ``high``. ``prefix`` and ``bits``: the keys still open, prefix <= key < prefix + 2^bits;
#: ``field``: 0 the score, 1 the id, 2 the row. ``score`` and ``tied``: the values found for the fields before it. ``need``: rows wanted of the open ones.
_WINDOW = "struct<window: long, same: boolean, low: long, high: long, field: int, prefix: long, bits: int, score: long, tied: long, need: long>"
_HITS = "window long, rid long, id long, score long"


@dataclass(frozen=True)
class Config:
    """``share`` and ``share_to``: a negative's score is wanted from so many hundredths of the positive's score up to so many."""

    positives: int = 5
    negatives: int = 3
    share: int = 50
    share_to: int = 95
    scale: int = 256
    digit: int = 8
    gather: int = 32
    anchors: int = 2048
    slices: int = 8
    slice_rows: int = 1 << 18


# ------------------------------------------------------------------------------------ one block of anchors against a slice of rows


class _Some:
    """Rows of one slice of a batch, or the anchors of a block: numbers, and vectors by their length."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.rid, self.id, self.label = (table.column(c).to_numpy() for c in ("rid", "id", "label"))
        vectors = table.column("vector").combine_chunks()
        lengths, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
        begins = np.cumsum(lengths) - lengths
        #: (length, the rows with vectors of it, their vectors)
        self.widths = {int(w): (at := np.flatnonzero(lengths == w), values[begins[at][:, None] + np.arange(w)]) for w in np.unique(lengths)}


class _Block:
    """The anchors of a block with their windows."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.some = _Some(parts)
        windows = [w for part in parts for w in part.column("windows").to_pylist()]
        self.windows = [w for of_anchor in windows for w in of_anchor]
        self.of_anchor = np.cumsum([0] + [len(w) for w in windows])

    def scores(self, rows: _Some) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the window, window, the rows it is about, their scores, those that its side allows) for each window.

        Products are exact, and made for 256 anchors at a time.
        """
        for width, (which, a) in self.some.widths.items():
            if width not in rows.widths:
                continue
            at, b = rows.widths[width]
            label, rids = rows.label[at], rows.rid[at]
            # Doubles hold whole numbers exactly up to 2^53, and are multiplied much faster.
            exact = float(np.abs(a).max()) * float(np.abs(b).max()) * width < 2**53
            flat = b.astype(float).T if exact else b.T
            for start in range(0, len(which), 256):
                some = a[start : start + 256]
                product = (some.astype(float) @ flat).astype(np.int64) if exact else some @ flat
                for k, anchor in enumerate(which[start : start + 256]):
                    same, other = label == self.some.label[anchor], rids != self.some.rid[anchor]
                    for w in range(self.of_anchor[anchor], self.of_anchor[anchor + 1]):
                        window = self.windows[w]
                        yield w, window, at, product[k], same & other if window["same"] else ~same


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block | None, _Some | None]]:
    """(block, rows) for each slice of rows that meets a block of anchors, and (block, None) where a block ends.

    Rows come sorted by block, its anchors first; only the anchors and one batch are held.
    """
    key, parts, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("i", "j", "is_row")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in itertools.pairwise(cuts):
            now, part = tuple(keys[:2, start].tolist()), batch.slice(start, stop - start)
            if now != key:
                if block is not None:
                    yield block, None
                key, parts, block = now, [], None
            if not keys[2, start]:
                parts.append(part)
                continue
            if block is None and parts:
                block = _Block(parts)
            if block is not None:
                yield block, _Some([part])
    if block is not None:
        yield block, None


def _open(window: dict, score: np.ndarray, mask: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one anchor's rows: which are open in the window, and all rows' keys in its field (smaller keys come first)."""
    if window["field"] == 0:
        return mask & (score >= window["low"]) & (score <= window["high"]), window["high"] - score
    open_ = mask & (score == window["score"])
    if window["field"] == 1:
        return open_, ids
    return open_ & (ids == window["tied"]), rids


def _histograms(config: Config):
    """For each window one histogram of a digit over all rows that met its block in this task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = 1 << config.digit, None
        for block, rows in _blocks_of(batches):
            if rows is None:
                at, digit = np.nonzero(total) if total is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                names = np.array([w["window"] for w in block.windows], dtype=np.int64)
                n = total[at, digit] if total is not None else at
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(digit, pa.int64()), pa.array(n, pa.int64())], ["window", "digit", "n"])
                total = None
                continue
            if total is None:
                total = np.zeros((len(block.windows), size), np.int64)
            for w, window, which, score, mask in block.scores(rows):
                open_, key = _open(window, score, mask, rows.id[which], rows.rid[which])
                # In unsigned 64-bit numbers differences of any two longs are whole.
                past = key[open_].astype(np.uint64) - np.array(window["prefix"]).astype(np.uint64)
                if window["bits"] < 64:
                    past = past[past < np.uint64(1 << window["bits"])]
                total[w] += np.bincount((past >> np.uint64(max(window["bits"] - config.digit, 0))).astype(np.int64), minlength=size)

    return counted


def _gathered(config: Config):
    """Rows up to the digit found: all open rows of a smaller key in the fields before, and those up to the last open one."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks_of(batches):
            parts = []
            for _, window, which, score, mask in block.scores(rows) if rows is not None else ():
                ids, rids = rows.id[which], rows.rid[which]
                inside = mask & (score >= window["low"]) & (score <= window["high"])
                # The last open key: prefix + 2^bits - 1 in the field; ``bits`` is what is left below the digit found.
                last = min(window["prefix"] + (1 << window["bits"]) - 1, 2**63 - 1)
                if window["field"] == 0:
                    take = inside & (window["high"] - score <= last)
                else:
                    tied = score == window["score"]
                    take = inside & (score > window["score"])
                    take |= inside & tied & ((ids <= last) if window["field"] == 1 else (ids < window["tied"]) | ((ids == window["tied"]) & (rids <= last)))
                at = np.flatnonzero(take)
                if len(at):
                    parts.append((np.full(len(at), window["window"]), rids[at], ids[at], score[at]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["window", "rid", "id", "score"])

    return hits


# ------------------------------------------------------------------------------------ rounds


class _Blocks:
    """The rows in slices, and the anchors among them in blocks: each block meets each slice."""

    def __init__(self, vectors: DataFrame, anchors: DataFrame, config: Config):
        self.vectors, self.anchors, self.config = vectors, anchors, config
        self.n_i = max(1, -(-anchors.count() // config.anchors))
        self.n_j = max(config.slices, -(-vectors.count() // config.slice_rows))

    def meet(self, windows: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on each block of anchors that have windows (rid, w) with each slice of rows."""
        per = windows.groupBy("rid").agg(F.collect_list("w").alias("windows"))
        of = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = self.anchors.join(per, "rid").select("rid", "id", "label", "vector", "windows", of(self.n_i).alias("i"), F.lit(0).alias("is_row")).withColumn("j", every(self.n_j))
        rows = self.vectors.select("rid", "id", "label", "vector", of(self.n_j).alias("j"), F.lit(1).alias("is_row")).withColumn("i", every(self.n_i))
        both = asked.unionByName(rows, allowMissingColumns=True)
        return both.repartition("i", "j").sortWithinPartitions("i", "j", "is_row").mapInArrow(work, schema)


def _bits(span: Column) -> Column:
    """The bits of a non-negative number; of null (a difference of 2^63 or more) all 64."""
    return F.when(span.isNull(), 64).when(span == 0, 0).otherwise(F.length(F.bin(span))).cast("int")


def _select(blocks: _Blocks, windows: DataFrame, k: int, config: Config, name: str) -> DataFrame:
    """(window, rid, id, score, rank) of the first ``k`` rows of each window. ``windows``: (rid, window, same, low, high)."""
    spark = windows.sparkSession
    bounds = blocks.vectors.agg(F.min("id").alias("id"), F.max("id").alias("id_to"), F.min("rid").alias("rid"), F.max("rid").alias("rid_to")).first()
    span = F.try_subtract("high", "low")
    first = [F.lit(0).alias("field"), F.lit(0).cast("long").alias("prefix"), _bits(span).alias("bits")]
    none = [F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("tied"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("before")]
    state = materialize(windows.where("low <= high").select("rid", "window", "same", "low", "high", *first, *none), f"{name}-windows")
    decided: DataFrame | None = None
    packed = F.struct("window", "same", "low", "high", "field", "prefix", "bits", "score", "tied", "need").cast(_WINDOW).alias("w")
    while not state.isEmpty():
        with scratch(spark, f"{name}-next", f"{name}-decided"):
            counts = blocks.meet(state.select("rid", packed), _histograms(config), "window long, digit long, n long")
            counts = counts.groupBy("window", "digit").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))
            counts = counts.withColumn("upto", upto).join(state.select("window", "need"), "window")
            # The digit that holds the last wanted row, or the last digit of all where there are fewer rows.
            whole = F.max_by(F.struct("digit", "n", "upto"), "digit")
            held = F.min_by(F.struct("digit", "n", "upto"), F.when(F.col("upto") >= F.col("need"), F.col("digit")))
            found = counts.groupBy("window").agg(F.coalesce(held, whole).alias("d"))
            left = F.greatest(F.col("bits") - config.digit, F.lit(0))
            # In decimals, as a digit of 64 bits is no long before the least key is added.
            place = F.expr(f"cast(cast(prefix AS decimal(20, 0)) + cast(d.digit AS decimal(20, 0)) * cast(shiftleft(1L, greatest(bits - {config.digit}, 0)) AS decimal(20, 0)) AS long)")
            step = state.join(found, "window").select(
                "rid", "window", "same", "low", "high", "field", place.alias("prefix"), left.alias("bits"),
                "score", "tied", (F.col("need") - (F.col("d.upto") - F.col("d.n"))).alias("need"), (F.col("before") + F.col("d.upto") - F.col("d.n")).alias("before"), F.col("d.n").alias("n"),
            )
            step = materialize(step, f"{name}-step")
            # Fewer rows than wanted, or few beyond: they are gathered. A row's own number has no ties.
            enough = (F.col("n") <= F.col("need")) | (F.col("before") + F.col("n") <= config.gather) | ((F.col("field") == 2) & (F.col("bits") == 0))
            done = materialize(step.where(enough).drop("n", "before"), f"{name}-decided")
            decided = done if decided is None else decided.unionByName(done)
            more = step.where(~enough)
            value, next_field = F.col("bits") == 0, F.col("field") + 1
            state = materialize(
                more.select(
                    "rid", "window", "same", "low", "high",
                    F.when(value, next_field).otherwise(F.col("field")).alias("field"),
                    F.when(~value, F.col("prefix")).when(next_field == 1, F.lit(bounds["id"])).otherwise(F.lit(bounds["rid"])).cast("long").alias("prefix"),
                    F.when(~value, F.col("bits")).when(next_field == 1, _wide(bounds["id"], bounds["id_to"])).otherwise(_wide(bounds["rid"], bounds["rid_to"])).cast("int").alias("bits"),
                    F.when(value & (next_field == 1), F.col("high") - F.col("prefix")).otherwise(F.col("score")).alias("score"),
                    F.when(value & (next_field == 2), F.col("prefix")).otherwise(F.col("tied")).alias("tied"), "need", "before",
                ),
                f"{name}-next",
            )
    if decided is None:
        return spark.createDataFrame([], f"{_HITS}, rank int")
    hits = blocks.meet(decided.select("rid", packed), _gathered(config), _HITS)
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id", "rid"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _wide(low: int, high: int) -> Column:
    return F.lit(int(high - low).bit_length())


def quantised(vector: Column, scale: int) -> Column:
    """The vector as whole numbers, or null where it can take no part."""
    made = F.transform(vector, lambda x: F.floor(scale * x.cast("double")))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x.cast("double")) < 2.0**26))
    return F.when(F.coalesce(sound, F.lit(False)) & (F.size(vector) > 0), made)


def mine(df: DataFrame, is_anchor: Column, config: Config = Config(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on columns of ``df``. Positives are an anchor's first ``config.positives`` other rows of its
    label; a pair's negatives are its first ``config.negatives`` rows of other labels in the pair's window of scores.
    """
    spark = df.sparkSession
    with scratch(spark, "negatives", "pairs"):
        label = F.col(label_col).cast("long")
        made = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), quantised(F.col(vector_col), config.scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        made = made.where("id is not null and label is not null and vector is not null").withColumn("rid", F.monotonically_increasing_id())
        vectors = materialize(made, "vectors")
        anchors = vectors.where("asks")
        blocks = _Blocks(vectors, anchors, config)
        most = vectors.agg(F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0] or 0
        # By Cauchy and Schwarz no score is beyond the largest square of a length.
        windows = anchors.select("rid", F.col("rid").alias("window"), F.lit(True).alias("same"), F.lit(-most).cast("long").alias("low"), F.lit(most).cast("long").alias("high"))
        positives = _select(blocks, windows, config.positives, config, "positives")
        pairs = positives.select(F.monotonically_increasing_id().alias("pair"), F.col("window").alias("rid"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = materialize(pairs.join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid"), "pairs")
        of_score = lambda share: F.col("positive_score").cast("decimal(20,0)") * F.lit(share).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
        low, high = F.ceil(of_score(config.share)), F.floor(of_score(config.share_to))
        windows = pairs.select("rid", F.col("pair").alias("window"), F.lit(False).alias("same"), low.cast("long").alias("low"), high.cast("long").alias("high"))
        negatives = materialize(_select(blocks, windows, config.negatives, config, "negatives").withColumnRenamed("window", "pair"), "negatives")
    out = pairs.join(negatives, "pair")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
