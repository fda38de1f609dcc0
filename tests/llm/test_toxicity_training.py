"""The toxicity model learns from every labelled row, whatever the partitions, and its thresholds are the best ones."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lacuna.llm import memory, toxicity


def test_every_labelled_row_and_whole_texts_are_learnt(spark):
    """A word of twenty rows among thousands, and one behind 25,000 characters, are in the model's table."""
    letters = F.translate(F.floor(F.col("id") / 20).cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words q"), letters, F.lit("z"), F.when(F.col("id") < 20, F.concat(F.repeat(F.lit(" pad"), 6250), F.lit(" behind"))).otherwise("")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    config = toxicity.Config(epochs=1)
    model = toxicity.fit(docs, labels, config)
    words = ["q" + str(k).translate(str.maketrans("0123456789", "abcdefghij")) + "z" for k in range(1200)] + ["behind"]
    assert [w for w in words if toxicity.piece_hashes(w, config.buckets)[-1] not in model.rows] == []


def test_shards_learn_one_model_whatever_the_partitions(spark):
    rng = random.Random(9)
    rows = []
    for k in range(1600):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(0, 60))]
        if toxic := rng.random() < 0.25:
            words[len(words) // 2 : len(words) // 2] = ["vilename", "wretchname"]
        rows.append((k, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    config = toxicity.Config(shard_rows=200, shard_words=3000)
    models = [toxicity.fit(f.select("doc_id", "text"), f.select("doc_id", "toxic"), config) for f in (frame, frame.repartition(7, "text"))]
    for a, b in zip([models[0].table, *models[0].kernels, *models[0].biases, models[0].out], [models[1].table, *models[1].kernels, *models[1].biases, models[1].out], strict=True):
        assert np.array_equal(a, b)
    assert models[0].shifts == models[1].shifts and models[0].bias == models[1].bias
    assert np.mean((toxicity.Scorer(models[0]).scores([r[1] for r in rows]) >= 0.3) == [r[2] for r in rows]) > 0.99


def test_a_step_follows_the_gradient():
    """One step with a tiny rate lowers the loss by rate times the gradient's square over its root."""
    texts, labels = ["some vile words here", "some good words", "", "x " * 40 + "vile"], np.array([1, 0, 0, 1])
    counts, vocabulary = np.zeros((2, 1 << 12), dtype=np.int32), toxicity.Vocabulary(1 << 12)
    toxicity._add_counts(counts, texts, labels.tolist(), vocabulary)
    known = np.flatnonzero(counts.any(axis=0))
    config = toxicity.Config(buckets=1 << 12, rate=1e-4, epochs=1)
    t = toxicity._start(known, *counts[:, known], [2, 2], config)
    t.model.table[1:] = np.random.default_rng(4).normal(0, 0.5, t.model.table[1:].shape)  # no response lies at a bend
    (shard,) = toxicity._shards(zip(texts, labels.tolist(), strict=True), known, config)
    assert shard.labels.tolist() == labels.tolist() and shard.ends.tolist() == [4, 7, 7, 48]

    def loss(model):
        p = 1 / (1 + np.exp(-toxicity.Scorer(model).logits(texts)[0].astype(np.float64)))
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    for chunk in (1 << 16, 5):
        after = t.copy()
        changed = np.zeros(len(after.table_squares), dtype=bool)
        toxicity._step(after, [shard.words[a:b] for a, b in zip([0, 4, 7, 7], shard.ends, strict=True)], shard.labels, shard.pieces, changed, chunk)
        moves = [(b - a).astype(np.float64) for a, b in zip([t.model.table, *t.params()], [after.model.table, *after.params()], strict=True)]
        squares = [np.broadcast_to(after.table_squares[:, None], moves[0].shape), *after.squares]
        moves, squares = [*moves, np.array([after.model.bias - t.model.bias])], [*squares, np.array([after.bias_square])]
        expected = -sum(float((m * m * np.sqrt(s)).sum()) for m, s in zip(moves, squares, strict=True)) / config.rate
        assert expected < 0 and abs((loss(after.model) - loss(t.model)) / expected - 1) < 0.02


def test_thresholds_by_counts_are_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    units, hits = rng.integers(-40, 40, 500), rng.integers(0, 2, 500)
    hits |= units > 20
    by_unit = pd.DataFrame({"unit": units, "rows": 1, "hits": hits}).groupby("unit").sum().sort_index(ascending=False)
    cut = toxicity._best_threshold(by_unit.index.to_numpy().astype(float), by_unit["rows"].to_numpy(), by_unit["hits"].to_numpy())

    def f1(at):
        return 2 * hits[units >= at].sum() / ((units >= at).sum() + hits.sum())

    assert abs(f1(cut) - max(f1(u) for u in range(-41, 41))) < 1e-12


def test_an_epoch_copies_only_the_rows_that_its_shard_uses():
    config = toxicity.Config()
    known = np.arange(0, config.buckets, 4)
    t = toxicity._start(known, np.ones(len(known)), np.ones(len(known)), [2, 2], config)
    (shard,) = toxicity._shards(iter([("some vile words here", 1), ("some good words", 0)]), known, config)
    tracemalloc.start()
    keys, changes = toxicity._changes(t, shard, [1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < t.model.table.nbytes / 10 and set(keys[keys >= 0]) <= set(shard.pieces.ravel()) - {0} and (keys >= 0).any()
    assert changes.shape == (len(keys), config.dim + 1)


COUNTING = """
import io, re, string
import numpy as np, pandas as pd, pyarrow as pa
from lacuna.llm import toxicity

def own_mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Rows:
    def select(self, *columns):
        return self
    def mapInPandas(self, work, schema):
        self.work = work
        raise StopIteration

def batches():
    # As a worker reads them: from an Arrow stream, a batch of 16 MB at a time.
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list(string.ascii_lowercase), (100_000, 7))], dtype=object)
    for _ in range(3):
        table = pa.table({"text": [" ".join(words[rng.integers(0, len(words), 250)]) for _ in range(8000)], "label": np.zeros(8000, dtype=np.int64)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        file = sink.getvalue().to_pybytes()
        del table, sink, stream
        yield from (pa.Table.from_batches([b]).to_pandas() for b in pa.ipc.open_stream(io.BytesIO(file)))

rows = Rows()
try:
    toxicity._counted(rows, toxicity.Config())
except StopIteration:
    pass
sum(len(b) for b in rows.work(iter([pd.DataFrame({"text": ["a word"], "label": [1]})])))
before = own_mb()
assert sum(len(b) for b in rows.work(batches())) > 50_000
print(own_mb() - before)
"""


def test_a_worker_gives_back_what_counting_took():
    found = subprocess.run([sys.executable, "-c", COUNTING], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[2], check=True)
    assert float(found.stdout) < 50


def test_a_task_makes_one_shard(spark):
    rows = spark.range(4000).select(F.lit("some words here").alias("text"), F.lit(0).alias("label"), F.xxhash64("id").alias("order"), F.col("id").cast("string").alias("id"))
    config = toxicity.Config(shard_rows=400)
    t = toxicity._start(np.arange(8), np.ones(8), np.ones(8), [2, 2], config)
    shards = toxicity._staged(rows, 4000, t, config)
    per_file = [r["count"] for r in shards.groupBy(F.input_file_name()).count().collect()]
    assert per_file == [1] * 10


def test_batches_to_workers_are_bounded_in_bytes(spark):
    memory.small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"size": [int(batch["text"].str.len().sum())]})

    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = [r["size"] for r in texts.mapInPandas(sizes, "size long").collect()]
    assert sum(found) == 200 * 100_000 and max(found) <= memory.BATCH_BYTES + 200_000


def test_pieces_of_words_in_any_letters():
    words = ["a", "abc", "abcdefghij", "größeres", "многословие", "ab\ud800cdef", ""]
    for word, found in zip(words, toxicity._pieces(words, 1 << 22).tolist(), strict=True):
        hashes = toxicity.piece_hashes(word, 1 << 22)
        assert found == hashes + [-1] * (toxicity.MOST_PIECES - len(hashes))
