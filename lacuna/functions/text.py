"""Text normalisation as Catalyst expressions: headers and cells to plain lower-case ASCII words.

Each step has a fast path on plain text, so that the interpreted array functions run only on cells that
need them.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.lexicon import ABBREVIATIONS, ACRONYMS, COLUMN_TYPE_NAMES, PRIORITY_PATTERN

_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(r"\s", c))
_ASCII_SPACE = r"[\t-\r\x1c-\x20]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends, in the sense of Unicode."""
    return F.trim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """The runs of other characters than white space, in the sense of Unicode."""
    return F.filter(F.split(text, f"[{re.escape(_SPACES)}]+"), lambda w: w != "")


@functools.cache
def _ascii_targets() -> tuple[str, str, dict[str, str]]:
    """By compatibility decomposition: characters with one ASCII letter left, those letters, and the rest with several."""
    single, letters, several = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append(chr(code))
            letters.append(plain)
        elif plain:
            several[chr(code)] = plain
    return "".join(single), "".join(letters), several


def ascii_fold(text: Column) -> Column:
    """ASCII letters of the compatibility decomposition; what has none is dropped."""
    single, letters, several = _ascii_targets()
    mapping = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    marks = "".join(several)

    def unfolded(one: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(one, F.lit(r"(?s)([\x00-\x7f]+|.)"), 1), lambda c: F.coalesce(mapping[c], c))
        return F.when(one.rlike(f"[{marks}]"), F.array_join(parts, "")).otherwise(one)

    def folded(full: Column) -> Column:
        plain = F.regexp_replace(let(F.translate(full, single, letters), unfolded), r"[^\x00-\x7f]+", "")
        return F.when(full.rlike(r"\A[\x00-\x7f]*\z"), full).otherwise(plain)

    return let(text, folded)


def split_words(text: Column) -> Column:
    """camelCase, snake_case and kebab-case as words with one space between them."""
    for pattern, by in ((r"[_\-]+", " "), (r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (rf"{_ASCII_SPACE}+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def expand_abbreviations(text: Column) -> Column:
    """Known abbreviations as full words; each word is looked up once, in any case."""
    mapping = F.from_json(F.lit(json.dumps(ABBREVIATIONS)), "map<string,string>")

    def expanded(full: Column) -> Column:
        tokens = F.regexp_extract_all(full, F.lit(r"(\w+|\W+)"), 1)
        long = F.array_join(F.transform(tokens, lambda t: F.coalesce(mapping[F.lower(t)], t)), "")
        return F.when(full.rlike(rf"(?i)\b(?:{'|'.join(ABBREVIATIONS)})\b"), long).otherwise(full)

    return let(text, expanded)


def lower_words(text: Column) -> Column:
    """Lower case, but for words all in capitals of at most three characters and the known acronyms."""
    short = r"(?=[A-Z0-9]*[A-Z])[A-Z0-9]{1,3}"
    kept = rf"(?:{short}|{'|'.join(ACRONYMS)})"

    def lowered(full: Column) -> Column:
        tokens = F.regexp_extract_all(full, F.lit(r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"), 1)
        mixed = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(rf"\A{kept}\z"), t).otherwise(F.lower(t))), "")
        return F.when(full.rlike(rf"(?<![A-Za-z0-9]){kept}(?![A-Za-z0-9])"), mixed).otherwise(F.lower(full))

    return let(text, lowered)


def normalize(text: Column) -> Column:
    """The normal form of a header or a cell; null stays null."""
    text = ascii_fold(strip(text))
    text = F.regexp_replace(text, rf"{_ASCII_SPACE}*\|{_ASCII_SPACE}*", " ")
    text = F.regexp_replace(text, rf"\b([A-Za-z])\.{_ASCII_SPACE}*([A-Za-z])\.", "$1$2")
    return lower_words(expand_abbreviations(split_words(text)))


def column_type(name: Column) -> Column:
    """The label of a column: its normal form, renamed where a name is known."""
    mapping = F.from_json(F.lit(json.dumps(COLUMN_TYPE_NAMES)), "map<string,string>")
    return let(normalize(name), lambda normal: F.coalesce(mapping[normal], normal))


def safe_name(text: Column) -> Column:
    """A text as part of a file's name: each run of characters other than ASCII letters, digits and underscores is one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_]+", "_")


def is_priority(name: Column, pattern: str = PRIORITY_PATTERN) -> Column:
    """Whether a column's normal form belongs to the families that are drawn first."""
    return normalize(name).rlike(pattern)
