"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each document goes, as it comes, into the fill level h for which the sum over levels of N(h)^2 after
the placement is least, where N(h) counts the partially filled windows of level h; level 0 is a new
window. The counts are a level array. Documents longer than a window are first cut into whole windows
and a rest, and the rest is placed like a document.

A task packs the rows it reads, so nothing is shuffled and a lost task is repeated alone. When its
input ends, windows still open are closed by cutting: the emptiest windows' pieces fill the gaps of
the fullest ones. At most one window stays partly filled; its pieces are dealt into windows whose
lengths are powers of two, which need no padding.

Of a document with a piece in an open window, only the rest that is shorter than a window is held.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried
from lacuna.llm.tokens import encode_text

#: A piece of a document: its row, start and length in tokens.
Piece = tuple[int, int, int]


class SumOfSquares:
    """The open windows of one task. ``place`` and ``close`` return the windows that are now full."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)  # N(h); N(0) and N(window) stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level whose use for an item of ``size`` gives the least sum of squares; the highest of equals."""
        room = self.window - size
        n = self.counts
        # from level h to h + size: -2 N(h) + 1 for the level left, +2 N(h + size) + 1 for the one reached
        change = 2 * n[size : self.window + 1] + 1 - 2 * n[: room + 1] + 1
        change[0] -= 1  # a new window leaves no level
        change[room] -= 2 * n[self.window] + 1  # a full window is at no level
        usable = np.flatnonzero(n[: room + 1])
        best, least = 0, change[0]
        if len(usable):
            k = usable[len(usable) - 1 - int(np.argmin(change[usable][::-1]))]
            if change[k] <= least:
                best = int(k)
        return best

    def place(self, piece: Piece) -> list[list[Piece]]:
        size = piece[2]
        if size == self.window:
            return [[piece]]
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return [pieces]
        self.counts[level + size] += 1
        self.open[level + size].append(pieces)
        return []

    def close(self) -> Iterator[list[Piece]]:
        """Close all windows: the fullest are filled from the emptiest, the last is dealt into powers of two."""
        levels = [(h, pieces) for h in range(1, self.window) for pieces in self.open[h]]
        self.__init__(self.window)
        low, high, spare = 0, len(levels) - 1, []
        while low <= high or spare:
            filled, pieces = 0, []
            if low <= high:
                filled, pieces = levels[high][0], list(levels[high][1])
                high -= 1
            while filled < self.window and (spare or low <= high):
                if not spare:
                    spare = levels[low][1][::-1]
                    low += 1
                row, start, length = spare.pop()
                used = min(length, self.window - filled)
                pieces.append((row, start, used))
                filled += used
                if used < length:
                    spare.append((row, start + used, length - used))
            if filled == self.window:
                yield pieces
            else:
                yield from _powers_of_two(pieces, filled)


def _powers_of_two(pieces: list[Piece], filled: int) -> Iterator[list[Piece]]:
    """Deal pieces into windows of the powers of two whose sum is their length, the largest first."""
    rest = pieces[::-1]
    for bit in range(filled.bit_length() - 1, -1, -1):
        size = filled & (1 << bit)
        dealt = []
        while size:
            row, start, length = rest.pop()
            used = min(length, size)
            dealt.append((row, start, used))
            size -= used
            if used < length:
                rest.append((row, start + used, length - used))
        if dealt:
            yield dealt


_ENCODERS: dict[str, Callable[[list[str]], Iterator[list[int]]]] = {}

#: The pattern by which the byte-level pre-tokenizer splits text (fixed by the file format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable Latin-1 is itself, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file's merges are in the order of their ids and nothing else changes the text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    if not plain or not all(x.get("special") for x in spec["added_tokens"]):
        return None
    vocab, byte = model["vocab"], _byte_of_char()
    made = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    special = {x["content"] for x in spec["added_tokens"]}
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 + len(special & vocab.keys()) != len(vocab):
        return None
    return {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}


def load_encoder(path: str) -> Callable[[list[str]], Iterator[list[int]]]:
    """The encoder of a tokenizer file, built once in each Python process; special strings in a text are ordinary text.

    A plain byte-level BPE file, whose ids follow its merges, is run by the tiktoken library, which gives the same
    ids in a quarter of the time (the tests compare both on every code point); any other file by tokenizers.
    """
    if path not in _ENCODERS:
        ranks = _ranks(path)
        if ranks is not None:
            import tiktoken

            encoding = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[path] = lambda texts: (encode_text(encoding, text) for text in texts)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _ENCODERS[path] = lambda texts: (tokenizer.encode(text, add_special_tokens=False).ids for text in texts)
    return _ENCODERS[path]


def pack(df: DataFrame, tokenizer_file: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: where its tokens stand in its document and in its sequence.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the
    piece's token ids. Null text counts as empty, which is ``end_id`` alone. Each row of ``df`` is a
    document of its own, repeated rows too. ``sequence_id`` has the task's partition in its upper bits.
    """
    carried = Carried(df, id_col)
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder(tokenizer_file)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        state = SumOfSquares(window)
        # Of each document that has a piece in an open window: id, tokens, ids of the rest that is not cut to windows.
        known: dict[int, tuple] = {}
        rows: list[tuple] = []
        row = -1

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length in pieces:
                key, n, tail_start, tail = known[doc]
                raw = tail[4 * (start - tail_start) : 4 * (start - tail_start + length)]
                rows.append((key, start, length, zlib.crc32(raw), n, sequence, offset, *[np.frombuffer(raw, dtype="<u4").astype(np.int64)] * with_ids))
                offset += length
                if start + length == n:  # pieces of a rest that is cut are dealt in order
                    del known[doc]
            sequence += 1

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            rows.clear()
            return out

        for batch in batches:
            texts = [text or "" for text in batch["text"]]
            for key, found in zip(batch["id"], encode(texts), strict=True):
                row += 1
                ids = np.asarray([*found, end_id], dtype="<u4")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    raw = ids[start : start + window].tobytes()
                    rows.append((key, start, window, zlib.crc32(raw), len(ids), sequence, 0, *[ids[start : start + window].astype(np.int64)] * with_ids))
                    sequence += 1
                if whole < len(ids):
                    known[row] = (key, len(ids), whole, ids[whole:].tobytes())
                    for pieces in state.place((row, whole, len(ids) - whole)):
                        emit(pieces)
                if len(rows) >= 20_000:
                    yield flushed()
            yield flushed()
        for pieces in state.close():
            emit(pieces)
            if len(rows) >= 20_000:
                yield flushed()
        yield flushed()

    narrow = df.select(carried.sent, F.col(text_col).alias("text"))
    schema = f"id {carried.kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return narrow.mapInPandas(packed, schema).select(carried.back, *columns[1:])
