"""What counts as missing: nulls, blanks, sentinels and placeholder phrases, as Catalyst expressions.

All functions take the cell's text form. ``is_missing`` is the one predicate that decides; the
classification adds kind and label.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.lexicon import (
    DATE_SENTINELS,
    DISGUISED_LITERALS,
    DISGUISED_PATTERNS,
    NOT_APPLICABLE_LABELS,
    NUMERIC_SENTINELS,
    SPACE,
)
from lacuna.functions.text import let, strip

_NUMBER = r"\A[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\z"


@functools.cache
def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode outside ASCII, and their values."""
    found = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def parse_number(stripped: Column) -> Column:
    """The number that a stripped text denotes, or null: digits of any script, single underscores between digits."""
    return let(ascii_digits(stripped), number_of_digits)


def number_of_digits(digits: Column) -> Column:
    """The number that a text of ASCII digits denotes, or null."""
    return F.when(digits.rlike(_NUMBER), F.replace(digits, F.lit("_"), F.lit("")).try_cast("double"))


def ascii_digits(stripped: Column) -> Column:
    """A stripped text that may be a number, with digits of any script as ASCII ones; null for others."""
    plain = stripped.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(stripped.rlike(r"\A[+\-.]{0,2}\p{Nd}"), F.when(plain, stripped).otherwise(F.translate(stripped, *_digits())))


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def pattern_label(low: Column) -> Column:
    """The first family of phrases that a stripped lower-case text is one of, or null."""
    label = F.when(low.rlike(_whole(DISGUISED_PATTERNS[0][1])), DISGUISED_PATTERNS[0][0])
    for name, pattern in DISGUISED_PATTERNS[1:]:
        label = label.when(low.rlike(_whole(pattern)), name)
    return label


#: A word of every phrase of a family whose pattern begins with any text, so that it would be tried on every cell from many places.
_WORD_OF = {"not_available_phrase": "available"}

#: The characters with which a phrase of another family can begin.
_FIRST = rf"[ndimuv?\-.*_—–…{SPACE}]"

# One anchor before all alternatives, and the first character before any of them: most cells are done with after one comparison.
_ANY_OTHER = rf"\A(?={_FIRST})(?:" + "|".join(f"(?:{p})" for name, p in DISGUISED_PATTERNS if name not in _WORD_OF) + r")\z"


def is_phrase(low: Column) -> Column:
    """Whether a stripped lower-case text is a placeholder phrase of any family."""
    found = low.rlike(_ANY_OTHER)
    for name, pattern in DISGUISED_PATTERNS:
        if name in _WORD_OF:
            found = found | (low.contains(_WORD_OF[name]) & low.rlike(_whole(pattern)))
    return found


def _is_placeholder(stripped: Column, low: Column, number: Column) -> Column:
    sentinel = F.coalesce(number.isin(*NUMERIC_SENTINELS), F.lit(False))
    return (stripped == "") | low.isin(*DISGUISED_LITERALS) | is_phrase(low) | sentinel


def is_missing(value: Column, is_null: Column | None = None) -> Column:
    """Null, blank, a numeric sentinel, a placeholder literal, or a placeholder phrase."""
    missing = let(strip(value), lambda s: _is_placeholder(s, F.lower(s), parse_number(s)))
    return F.coalesce(missing if is_null is None else is_null | missing, F.lit(True))


def with_missing(df: DataFrame, value: str = "value", is_null: str = "is_null", out: str = "missing") -> DataFrame:
    """``df`` with ``is_missing`` as a column, in steps that each are compiled: what several rules use is a column of its own."""
    steps = df.withColumn("__stripped", strip(F.col(value)))
    steps = steps.withColumns({"__low": F.lower("__stripped"), "__digits": ascii_digits(F.col("__stripped"))})
    missing = _is_placeholder(F.col("__stripped"), F.col("__low"), number_of_digits(F.col("__digits")))
    return steps.withColumn(out, F.coalesce(F.col(is_null) | missing, F.lit(True))).drop("__stripped", "__low", "__digits")


def _classified(low: Column) -> Column:
    label = F.when(is_phrase(low), pattern_label(low))
    kind = F.when(low == "", None).when(low.isin(*DISGUISED_LITERALS), "literal").when(is_phrase(low), "regex").when(low.isin(*DATE_SENTINELS), "date_sentinel")
    return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "regex", label).when(k.isNotNull(), low).alias("label")))


def classify_string(value: Column) -> Column:
    """(kind, label) of a text cell: literal, regex or date_sentinel; both null for others and for blanks."""
    return let(F.lower(strip(value)), _classified)


def classify_numeric(number: Column) -> Column:
    """(kind, label) of a number: numeric_sentinel and its integer text, or nulls."""
    hit = number.isin(*NUMERIC_SENTINELS)
    return F.struct(F.when(hit, "numeric_sentinel").alias("kind"), F.when(hit, number.cast("long").cast("string")).alias("label"))


def classify(value: Column, is_numeric: Column, is_null: Column) -> Column:
    """(kind, label) by the column's type; nulls for null cells."""
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("label"))
    return F.when(is_null | value.isNull(), none).when(is_numeric, classify_numeric(value.try_cast("double"))).otherwise(classify_string(value))


def classify_cell(value: Column, is_numeric: Column, is_null: Column, *, label_mode: str = "label", date_sentinels: bool = False) -> Column:
    """(missing_kind, special_token, original_value) of a cell.

    ``label_mode="raw"`` gives the raw cell as the token and a null original for nulls. Date sentinels are
    present, as the mask has it, unless ``date_sentinels`` is set.
    """
    null = is_null | value.isNull()
    # What the classification does not recognise is missing only if it is blank or a sentinel stored as text.
    other = let(strip(value), lambda s: (s == "") | F.coalesce(parse_number(s).isin(*NUMERIC_SENTINELS), F.lit(False)))
    facts = F.struct(classify(value, is_numeric, is_null).alias("found"), F.coalesce(other, F.lit(True)).alias("other"))

    def cell(fact: Column) -> Column:
        found = fact["found"]
        missing = null | fact["other"] | F.coalesce(found["kind"] != "date_sentinel", F.lit(False))
        labelled = F.coalesce(found["kind"].isNotNull() & (F.lit(date_sentinels) | (found["kind"] != "date_sentinel")), F.lit(False))
        kind = F.when(null, "nan").when(labelled | missing, "disguised").otherwise("present")
        if label_mode == "raw":
            token, original = F.when(~null & (labelled | missing), value), F.when(~null, value)
        else:
            token = F.when(null, None).when(labelled, found["label"]).when(missing & ~is_numeric & (strip(value) == ""), "empty string")
            original = F.when(null, "").otherwise(value)
        return F.struct(kind.alias("missing_kind"), token.alias("special_token"), original.alias("original_value"))

    return let(facts, cell)


def token_group(special_token: Column) -> Column:
    """unknown, not applicable, or null."""
    low = F.lower(strip(F.coalesce(special_token, F.lit(""))))
    return let(low, lambda t: F.when(t.startswith("unknown"), "unknown").when(t.isin(*NOT_APPLICABLE_LABELS), "not applicable"))


def format_cell(value: Column, number: Column, is_null: Column) -> Column:
    """A present cell's text: whole numbers of any size as integers, nulls as the empty text.

    From 2^63 on, an integer shows the number's shortest digits, filled with zeros.
    """
    whole = number.isNotNull() & ~F.isnan(number) & (number == F.rint(number)) & (F.abs(number) < float("inf"))
    shown = F.when(F.abs(number) < 2.0**63, number.cast("long").cast("string")).otherwise(F.format_string("%.0f", number))
    return F.when(is_null | value.isNull(), "").when(whole, shown).otherwise(value)
