"""Exact duplicates by deterministic block naming, with DataFrame operations only.

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks of the corpus
are dealt out by key, sorted, and given integer names by their place in that order. Then, level by level,
adjacent names are paired, the distinct pairs are sorted and named in turn, until each document has one
name. Two documents have the same last name of the same level only if they have the same pairs all the way
down, that is the same bytes: names stand for contents, not for hashes of them, so there are no collisions.

Block contents are shuffled once, to be named; documents find the names of their blocks by a 64-bit hash
of the block. Should two different blocks ever share that hash, the names under it are told apart by
content in a second step (``_resolve``), which costs nothing while there are none.

Hot groups: distinct blocks and pairs are pre-aggregated before they are shuffled, and the joins that carry
all rows have plain exchanges on both sides, so that adaptive execution splits a partition that one
frequent block or text makes large. Written tables cut the lineage between levels.

Defined results: null text counts as empty, which is one block of no bytes. Each row is a document, repeated
rows too. Of equal texts the row with the smallest id is kept (null ids come last); of repeated rows with the
same id exactly one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.columns import fresh
from lacuna.llm.storage import materialize, scratch

#: Bytes of a block. Most documents are one block; a text of n bytes takes log2(n / BLOCK_BYTES) levels.
BLOCK_BYTES = 4096

#: The white space that is one space for comparison: space, tab, line feed, vertical tab, form feed, return.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _blocks(raw: Column, size: int) -> Column:
    last = F.floor((F.greatest(F.octet_length(raw), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(raw, k * size + 1, F.lit(size)))


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows of ``keys``, sorted within the partitions they are dealt to, with integer names."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _resolve(occurrences: DataFrame, contents: DataFrame, names: DataFrame, shared: DataFrame) -> DataFrame:
    """Names for occurrences of blocks whose hash other blocks share: the k-th content has the k-th name."""
    order = Window.partitionBy("hash").orderBy("block")
    of_content = contents.join(shared, "hash", "left_semi").distinct().withColumn("k", F.row_number().over(order))
    of_name = names.join(shared, "hash", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("name")))
    told = of_content.join(of_name, ["hash", "k"]).select("hash", "block", "name")
    return occurrences.join(shared, "hash", "left_semi").join(told, ["hash", "block"])


def document_names(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row per document: rid (its row), id, text_sha256, and (level, name), which stand for its text."""
    raw = normalised(F.col(text_col)).cast("binary")
    contents = df.select(F.explode(_blocks(raw, block_bytes)).alias("block")).select(block_hash(F.col("block")).alias("hash"), "block")
    names = materialize(_named(contents, ["block", "hash"]).select("hash", "name"), "block-names")
    blocks = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), raw.alias("raw"))
    blocks = blocks.select("rid", "id", F.sha2("raw", 256).alias("text_sha256"), _blocks(F.col("raw"), block_bytes).alias("blocks"))
    rows = blocks.select("rid", "id", "text_sha256", F.size("blocks").alias("width"), F.posexplode("blocks").alias("pos", "block"))
    rows = rows.withColumn("hash", block_hash(F.col("block")))
    shared = names.groupBy("hash").count().filter("count > 1").select("hash")
    document, columns = ["rid", "id", "text_sha256"], ["rid", "id", "text_sha256", "width", "pos", "name"]
    if shared.isEmpty():
        state = rows.drop("block").join(names, "hash").select(columns)
    else:
        shared, rows = materialize(shared, "shared-hashes"), materialize(rows, "blocks")
        plain = rows.join(shared, "hash", "left_anti").drop("block").join(names, "hash").select(columns)
        state = plain.unionByName(_resolve(rows, contents, names, shared).select(columns))
    done: list[DataFrame] = []
    for level in itertools.count():
        state = materialize(state, f"blocks-{level}")
        done.append(state.filter("width = 1").select(*document, F.lit(level).alias("level"), "name"))
        state = state.filter("width > 1")
        if state.isEmpty():
            break
        half = [F.ceil(F.col("width") / 2).cast("int").alias("width"), F.floor(F.col("pos") / 2).cast("int").alias("pos")]
        first = F.max(F.when(F.col("pos") % 2 == 0, F.col("name")))
        second = F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1))  # no name is negative
        pairs = materialize(state.groupBy(*document, *half).agg(first.alias("a"), second.alias("b")), f"pairs-{level}")
        pair_names = materialize(_named(pairs, ["a", "b"]), f"pair-names-{level}")
        state = pairs.join(pair_names, ["a", "b"]).select(columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row per document, dropped ones too: the id, keep_id, group_size, kept, text_sha256."""
    with scratch(df.sparkSession, "document-names"):
        named = materialize(document_names(df, id_col, text_col, block_bytes, block_hash), "document-names")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = materialize(named.groupBy("level", "name").agg(least.alias("least"), F.count(F.lit(1)).alias("group_size")), "text-groups")
    joined = named.join(groups, ["level", "name"])
    return joined.select(
        F.col("id").alias(id_col), F.col("least.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("kept"), "text_sha256"
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns.

    Rows are found again by id and text; of repeated rows with the same id and text one stays,
    any of them if they differ in other columns.
    """
    with scratch(df.sparkSession, "duplicates"):
        found = materialize(duplicates(df, id_col, text_col), "duplicates")
    key, sha, of_text = (fresh(df, name) for name in ("__id", "__sha", "__text_sha"))
    kept = found.filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha))
    repeated = materialize(found.groupBy(F.col(id_col).alias(key)).count().filter("count > 1").select(key), "repeated-ids")
    same = F.col(id_col).eqNullSafe(F.col(key))
    if repeated.isEmpty():
        # Merged at every size: the ids grow with the corpus, so it must not depend on their fitting into a broadcast.
        return df.join(kept.select(key).hint("merge"), same, "left_semi")
    keyed = df.withColumn(of_text, F.sha2(normalised(F.col(text_col)), 256))
    rows = keyed.join(kept, same & (F.col(of_text) == F.col(sha)), "left_semi")
    once = rows.join(repeated, same, "left_anti")
    again = rows.join(repeated, same, "left_semi").dropDuplicates([id_col, of_text])
    return once.unionByName(again).drop(of_text)
