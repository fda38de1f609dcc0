"""Encoders: a registry of plug-ins that turn prepared input into vectors, in Arrow batches.

``hashing`` is built in, needs no model and runs as joins and sums (``operators.hashing``). Neural encoders are plug-ins that import their libraries when they
are first used; a worker loads a model once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import let
from lacuna.operators import hashing, vectors


class Embedder(Protocol):
    """``family`` is "sentence" or "table"; ``encode`` returns a row of ``hidden_size`` floats for each input."""

    family: str
    hidden_size: int

    def encode(self, inputs: list[str]) -> np.ndarray: ...


def _sentence_transformer(name: str, hidden_size: int) -> Embedder:
    from sentence_transformers import SentenceTransformer  # an optional plug-in

    from lacuna.functions.lexicon import EMPTY_TOKEN, MASK_TOKEN

    model = SentenceTransformer(name)
    model.tokenizer.add_tokens([EMPTY_TOKEN, MASK_TOKEN], special_tokens=True)
    model[0].auto_model.resize_token_embeddings(len(model.tokenizer))

    class Encoder:
        family = "sentence"

        def encode(self, inputs: list[str]) -> np.ndarray:
            return model.encode(inputs, batch_size=64, normalize_embeddings=True)

    encoder = Encoder()
    encoder.hidden_size = hidden_size
    return encoder


#: One row for a table encoder: its headers, its cells, and the target's position or None if it was removed.
TableRow = tuple[list[str], list[str], int | None]


def pool_cells(cells: np.ndarray, target: int | None) -> np.ndarray:
    """A row's vector from its cells' vectors: the target's, or the mean of all cells (zero ones count) without a target."""
    return cells[target] if target is not None else cells.mean(axis=0)


def _tapas(name: str, hidden_size: int) -> Embedder:
    import torch  # an optional plug-in, with transformers
    from transformers import TapasModel, TapasTokenizer

    from lacuna.functions.lexicon import MASK_TOKEN

    tokenizer, model = TapasTokenizer.from_pretrained(name), TapasModel.from_pretrained(name).eval()
    tokenizer.add_special_tokens({"additional_special_tokens": [MASK_TOKEN]})
    model.resize_token_embeddings(len(tokenizer))

    class Encoder:
        family = "table"

        def encode_tables(self, rows: list[TableRow]) -> np.ndarray:
            out = []
            for headers, cells, target in rows:
                inputs = tokenizer(table=pd.DataFrame([cells], columns=headers), queries=[""], padding="max_length", max_length=512, truncation=True, return_tensors="pt")
                with torch.no_grad():
                    states = model(**inputs).last_hidden_state[0].numpy()
                kinds = inputs["token_type_ids"][0].numpy()  # segment, column, row and others; data cells are of row 1
                cell_of = [states[(kinds[:, 2] == 1) & (kinds[:, 1] == j + 1)] for j in range(len(cells))]
                out.append(pool_cells(np.stack([c.mean(axis=0) if len(c) else np.zeros(hidden_size) for c in cell_of]), target))
            return np.stack(out)

    encoder = Encoder()
    encoder.hidden_size = model.config.hidden_size
    return encoder


#: Makers of plug-ins by family: (name, hidden_size) to an embedder. The families ``hashing`` and ``hashing_table`` need none.
FAMILIES: dict[str, Callable[[str, int], Embedder]] = {
    "minilm": _sentence_transformer,
    "tapas": _tapas,
}

#: Families that read tables; the others read sentences.
TABLE_FAMILIES = frozenset({"hashing_table", "tapas"})


@functools.cache
def load(family: str, name: str, hidden_size: int) -> Embedder:
    """The encoder of this Python process; its size must be the configured one."""
    if family not in FAMILIES:
        raise ValueError(f"unknown encoder family {family!r}; register it in FAMILIES")
    found = FAMILIES[family](name, hidden_size)
    if found.hidden_size != hidden_size:
        raise ValueError(f"{name} has {found.hidden_size} dimensions, the configuration says {hidden_size}")
    return found


def embed_column(df: DataFrame, text_col: str, family: str, name: str, hidden_size: int, out_col: str = "embedding") -> DataFrame:
    """Add the vectors of a text column."""
    if family == "hashing":
        return hashing.hash_texts(df, text_col, hidden_size, out_col)

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(family, name, hidden_size)
        for texts in batches:
            found = np.asarray(model.encode([t or "" for t in texts]), dtype=np.float32)
            if found.shape != (len(texts), hidden_size):
                raise ValueError(f"{name} returned {found.shape} for {len(texts)} inputs of size {hidden_size}")
            yield pd.Series(list(found))

    return df.withColumn(out_col, encoded(F.col(text_col)))


def embed_tables(df: DataFrame, family: str, name: str, hidden_size: int, out_col: str = "embedding") -> DataFrame:
    """Add the vectors of rows prepared as tables (``cells`` and ``target_position``)."""
    if family == "hashing_table":
        return hashing.hash_tables(df, hidden_size, out_col)

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load(family, name, hidden_size)
        for batch in batches:
            targets = [None if pd.isna(t) else int(t) for t in batch["target"]]
            rows = [(list(h), list(c), t) for h, c, t in zip(batch["headers"], batch["cells"], targets, strict=True)]
            found = np.asarray(model.encode_tables(rows), dtype=np.float32).reshape(len(rows), -1)
            if len(rows) and found.shape != (len(rows), hidden_size):
                raise ValueError(f"{name} returned {found.shape} for {len(rows)} rows of size {hidden_size}")
            yield pd.Series(list(found))

    shown = F.struct(F.transform("cells", lambda x: x["header"]).alias("headers"), F.transform("cells", lambda x: x["cell"]).alias("cells"), F.col("target_position").alias("target"))
    return df.withColumn(out_col, encoded(shown))


def cell_vectors(tokens: DataFrame, size: int) -> DataFrame:
    """(sample_id, row_id, col_idx, embedding): the mean of each cell's token vectors; a cell without tokens is zero.

    ``tokens``: (sample_id, row_id, col_idx, vector), where vector is null for a cell without tokens.
    """
    keys = ["sample_id", "row_id", "col_idx"]
    means = vectors.group_mean(tokens.where("vector is not null"), keys, "vector", "embedding")
    cells = tokens.select(*keys).distinct().join(means, keys, "left")
    return cells.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), F.lit(size))))


def row_vectors(cells: DataFrame) -> DataFrame:
    """(sample_id, embedding): the mean of a row's cells; the header row (row_id 0) has no part in it."""
    return vectors.group_mean(cells.where("row_id > 0"), ["sample_id"], "embedding", "embedding")


def attentions(df: DataFrame, layers: list[int] | None = None, heads: list[int] | None = None, renormalise: bool = True) -> DataFrame:
    """(sample_id, layer, head, weights) of ``df``'s sample_id and attention, layers x heads x tokens x tokens nested arrays.

    Sums and quotients are doubles, and a weight is then rounded to half precision. A row that sums to under 1e-6 is divided by that.
    Null tensors, layers and heads give no row; a layer or head beyond a tensor is an error.
    """

    def numbered(array: Column, wanted: list[int] | None) -> Column:
        return F.explode(F.transform(vectors.resolve_positions(wanted, F.size(array)), lambda k: F.struct(k.alias("at"), array[k].alias("value"))))

    def rounded(row: Column) -> Column:
        if not renormalise:
            return F.transform(row, lambda x: vectors.half_precision(x.cast("double")).cast("float"))
        total = F.greatest(F.aggregate(row, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(1e-6))
        return let(total, lambda t: F.transform(row, lambda x: let(x.cast("double") / t, vectors.half_precision).cast("float")))

    one = df.where("attention is not null").select("sample_id", numbered(F.col("attention"), layers).alias("l"))
    two = one.where("l.value is not null").select("sample_id", F.col("l.at").alias("layer"), numbered(F.col("l.value"), heads).alias("h"))
    return two.where("h.value is not null").select("sample_id", "layer", F.col("h.at").alias("head"), F.transform("h.value", rounded).alias("weights"))
