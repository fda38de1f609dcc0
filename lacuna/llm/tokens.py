"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding at safe boundaries: places where a space or line feed follows a
word character. No alternative of the splitting pattern can match across such a place (white space occurs
in a match only at its start or as the whole match), and the pattern's only look-ahead concerns what
follows white space, which no piece ends with. So the concatenated ids of
the pieces are the ids of the whole text, while each call to the encoder stays bounded.

A run of white space has no such place inside, and the splitting engine gives up on its look-ahead after a million
characters. Of a long run the pattern makes one match of all but the last character (or of the whole run at the end of the
text), as its last two alternatives say; that match is cut out and merged by itself, without the engine. This holds
for patterns in which only those two alternatives match more than one white-space character
(``WHITE_TAIL``); with any other pattern, texts are encoded as they are.

Null text counts as empty, and an empty text has no ids. Decoding returns raw bytes, so ids that
do not end on a character boundary need no replacement characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried

#: Texts over this many characters are encoded piece by piece, each piece about as long.
PIECE_CHARS = 65_536

#: Runs of white space over this many characters are matched without the splitting engine.
RUN_CHARS = 50_000

#: The end of patterns that are known to treat long white space as described above.
WHITE_TAIL = r"|\s+(?!\S)|\s+"

_SAFE = re.compile(r"(?<=\w)(?=[ \n])")
# The characters with Unicode's White_Space property, which is what the splitting engine's \s stands for.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_WHITE}]{{{RUN_CHARS},}}")
_ENCODINGS: dict[tuple[str, str], object] = {}


def load_encoding(rank_file: str, pattern: str):
    """The encoding for a rank file, built once in each Python process."""
    import tiktoken

    key = (rank_file, pattern)
    if key not in _ENCODINGS:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        _ENCODINGS[key] = tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after each ``piece_chars`` characters."""
    at = 0
    while len(text) - at > piece_chars:
        found = _SAFE.search(text, at + piece_chars)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def without_runs(text: str, run: re.Pattern[str] = _RUN) -> Iterator[tuple[str, bool]]:
    """The text in parts, with true for those that are one match of the pattern: a long run without its last character.

    A run starts a match, as no alternative goes from other characters into two of white space. Its last character
    is left to what follows, as it may begin the next match.
    """
    at = 0
    for m in run.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        yield text[at : m.start()], False
        yield text[m.start() : stop], True
        at = stop
    yield text[at:], False


def encode_text(encoding, text: str, piece_chars: int = PIECE_CHARS) -> list[int]:
    """The ids of the whole text, without special tokens."""
    if len(text) <= min(piece_chars, RUN_CHARS):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for part, is_match in without_runs(text) if encoding._pat_str.endswith(WHITE_TAIL) else ((text, False),):
        if is_match:
            ids += encoding._encode_single_piece(part)
        else:
            for piece in safe_pieces(part, piece_chars):
                ids += encoding.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Add ``out_col``, the array of token ids of ``text_col`` (null counts as empty).

    ``rank_file`` must be at the same path on every executor; it is read once in each Python worker.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(rank_file, pattern)
        for texts in batches:
            yield pd.Series([np.asarray(encode_text(encoding, text or "", piece_chars), dtype=np.int32) for text in texts])

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the ids in ``ids_col`` stand for (null ids: no bytes)."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(rank_file, pattern)
        for arrays in batches:
            yield pd.Series([b"" if ids is None else encoding.decode_bytes(list(ids)) for ids in arrays], dtype=object)

    return df.withColumn(out_col, raw(F.col(ids_col)))


def token_digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per row of ``df``: its id, the number of ids, and digests of the ids and of the decoded bytes.

    Encoding and decoding happen in one pass over Arrow batches, text by text, so that no id array
    leaves the Python worker. Repeated rows are repeated in the result; null and empty texts have 0 ids.
    """
    carried = Carried(df, id_col)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(rank_file, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = encode_text(encoding, text or "", piece_chars)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
            yield pd.DataFrame({"id": batch["id"], **dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows) if rows else ([], [], []), strict=True))})

    narrow = df.select(carried.sent, F.col(text_col).alias("text"))
    out = narrow.mapInPandas(digests, f"id {carried.kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(carried.back, "n_tokens", "ids_sha256", "decoded_sha256")
