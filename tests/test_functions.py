import random

from pyspark.sql import functions as F

from lacuna.functions import lexicon as lx
from lacuna.functions import missing as ms
from lacuna.functions import text as tx
from lacuna.sources import corpus

# Made by hand: a text, its normal form, and what is missing about it (kind and label; "" where only the mask has it, None where nothing is).
CASES = [
    ("customerID", "customer identifier", None, None), ("avg_bp", "average blood pressure", None, None), ("URLName", "URL name", None, None), ("U.S. state", "US state", None, None),
    ("U. S. x", "US x", None, None), ("Unnamed: 0", "unnamed: 0", None, None), ("__index_level_0__", "index level 0", None, None), ("café|size", "cafe size", None, None),
    ("ﬁne ½ ⑩", "fine 12 10", None, None), ("RNA levels", "ribonucleic acid levels", None, None), ("TAPEWORM ELISA USA II2", "tapeworm ELISA USA II2", None, None), ("MG", "milligram", None, None),
    ("  spaced\x1cout\x0b ", "spaced out", None, None), ("ABCWord", "ABC word", None, None), ("lib_name", "library name", None, None), ("Ａge", "age", None, None), ("A.B. c", "AB c", None, None),
    ("red", "red", None, None), ("not available today", "not available today", None, None), ("unknownx", "unknownx", None, None), ("unknown_x", "unknown x", None, None), ("missing x", "missing x", None, None),
    ("x" * 32 + " not available", "x" * 32 + " not available", None, None), ("9999d", "9999d", None, None), ("inf", "inf", None, None), ("1e5", "1e5", None, None),
    ("", "", "", None), (" ", "", "", None), ("-999", "999", "", None), ("-999.0", "999.0", "", None), ("9_999", "9 999", "", None), ("９９９９", "9999", "", None), ("99999e0", "99999e0", "", None), ("+9999", "+9999", "", None), ("-9.", "9.", "", None),
    ("___", "", "literal", "___"), ("N/A", "N/A", "literal", "n/a"), ("n-a", "n a", "literal", "n-a"), ("Unknown", "unknown", "literal", "unknown"), ("nan", "nan", "literal", "nan"), ("\xa0unknown　", "unknown", "literal", "unknown"),
    ("not  assigned", "not assigned", "regex", "not_<verb>"), ("NOT_disclosed", "NOT disclosed", "regex", "not_<verb>"), ("--  not applicable --", "not applicable", "regex", "dash_wrapped_not_applicable"),
    ("data for x not available", "data for x not available", "regex", "not_available_phrase"), ("information missing", "information missing", "regex", "<value>_missing"), ("missing entry", "missing entry", "regex", "missing_<noun>"),
    ("no\x1cdata", "no data", "regex", "no_<noun>"), ("dont  answer", "dont answer", "regex", "do(es)_not_<verb>"), ("unknown method", "unknown method", "regex", "unknown_<text>"),
    ("unknown\nif", "unknown if", "regex", "unknown_<text>"), ("N.D.", "ND", "regex", "n/d_variant"), ("— –…", "...", None, None), ("—–…", "...", "regex", "punctuation_only"), ("1970-01-01", "1970 01 01", "date", "1970-01-01"),
]


def test_expressions_match_the_table(spark):
    df = spark.createDataFrame([(v, n, k, label) for v, n, k, label in CASES], "v string, normal string, kind string, label string")
    v = F.col("v")
    rows = df.select("v", "normal", "kind", "label", tx.normalize(v).alias("n"), ms.is_missing(v).alias("m"), ms.classify_string(v).alias("c")).collect()
    wrong = [(r.v, r.n, r.m, tuple(r.c)) for r in rows if r.n != r.normal or r.m != (r.kind not in (None, "date")) or tuple(r.c) != ({"date": "date_sentinel"}.get(r.kind, r.kind or None), r.label)]
    assert not wrong, wrong


def _random_strings(n, seed=5):
    rng = random.Random(seed)
    parts = [*[c[0] for c in CASES], "not", "no", "unknown", "available", "data", " ", "_", "-", "\x1d", " ", "é", "ß", "Ⅷ", "9999", "id", "AVG", "fooBar", ".", "|", "ﷺ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_properties_of_random_texts(spark):
    """What must hold for any text: forms are plain, a mask does not see outer white space or case, kinds and mask agree."""
    values = [None, *_random_strings(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    v, n = F.col("v"), F.col("n")
    rows = ms.with_missing(df.withColumn("is_null", v.isNull()), "v", out="stepwise").withColumn("n", tx.normalize(v)).select(
        "v", "n", "stepwise", ms.is_missing(v).alias("m"), ms.is_missing(F.concat(F.lit(" \t"), F.upper(v), F.lit("\xa0"))).alias("around"), ms.is_missing(F.lower(v)).alias("low"),
        ms.classify_string(v).alias("c"), ms.classify_cell(v, F.lit(False), v.isNull())["missing_kind"].alias("k"), tx.normalize(F.lower(n)).alias("again"), F.lower(n).alias("lower"),
    ).collect()
    for r in rows:
        if r.v is None:
            assert r.n is None and r.m and r.stepwise and r.k == "nan"
            continue
        assert r.n.isascii() and r.n == " ".join(r.n.split()) and not set(r.n) & set("_|")
        assert r.stepwise == r.m == (r.k != "present")
        if r.v.upper().lower() == r.v.lower():  # not so for letters like ß
            assert r.m == r.around == r.low, r.v
        if r.c.kind in ("literal", "regex"):
            assert r.m and r.c.label
        if not r.v.strip():
            assert r.m and r.c.kind is None


def test_classify_cell_modes(spark):
    rows = [(None, False), ("N/A", False), ("  ", False), ("-999", False), ("-999.0", True), ("red", False), ("1970-01-01", False), ("-1", True)]
    df = spark.createDataFrame(rows, "v string, num boolean")
    cell = lambda **k: [tuple(r.c) for r in df.select(ms.classify_cell(F.col("v"), F.col("num"), F.col("v").isNull(), **k).alias("c")).collect()]
    assert cell() == [
        ("nan", None, ""), ("disguised", "n/a", "N/A"), ("disguised", "empty string", "  "), ("disguised", None, "-999"), ("disguised", "-999", "-999.0"), ("present", None, "red"),
        ("present", None, "1970-01-01"), ("disguised", "-1", "-1"),
    ]
    assert cell(date_sentinels=True)[6] == ("disguised", "1970-01-01", "1970-01-01")
    assert cell(label_mode="raw")[:2] == [("nan", None, None), ("disguised", "N/A", "N/A")]


def test_lists_are_whole():
    assert (len(lx.DISGUISED_LITERALS), len(set(lx.DISGUISED_LITERALS)), len(lx.ABBREVIATIONS), len(lx.COLUMN_TYPE_NAMES), len(lx.DISGUISED_PATTERNS)) == (88, 88, 54, 32, 13)


def test_column_names(spark):
    names = ["age 2", "total.case", "Unnamed: 3", "unnamed column 17", "__pandas_x", "Country", "homepage"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(tx.column_type(F.col("n")).alias("t"), tx.is_priority(F.col("n")).alias("p"), F.col("n").rlike(lx.INTERNAL_COLUMN_PATTERN).alias("i"), F.col("n").rlike(lx.INTERNAL_COLUMN_PATTERN_STRICT).alias("s")).collect()
    assert [r.t for r in got] == ["age", "total case", "unnamed: 3", "unnamed column 17", "pandas x", "country", "homepage"]
    assert [r.p for r in got] == [True, False, False, False, False, True, False]
    assert [r.i for r in got] == [False, False, True, True, True, False, False]
    assert [r.s for r in got] == [False, False, True, False, True, False, False]


def test_phrases_by_first_character_and_word(spark):
    """A cell is a phrase where any family's pattern matches as a whole, though most cells are passed over after their first character."""
    texts = ["not available", "sample not-available", "été not_available", "9 x not  available", "not available today", "available", "-- not applicable --", "value missing", "info_missing", "missing entry", "no-answer", "no answers", "doesn't know", "does not respond",
             "didn't apply", "unreported", "unknown, method", "unknown.", "unknowns", "n/a.", "n-d", "nd", "_—–…", "?.*", "　\t", "\x1c", "", "a", "10", "ж not available", "not known", "x" * 40 + " not available"]
    shown = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = ms._whole("|".join(f"(?:{p})" for _, p in ms.DISGUISED_PATTERNS))
    found = shown.select("t", ms.is_phrase(F.col("t")).alias("fast"), F.col("t").rlike(plain).alias("plain")).collect()
    assert [r.fast for r in found] == [r.plain for r in found] and sum(bool(r.fast) for r in found) == 23


def test_cells_are_made_in_compiled_code(spark):
    """The text of a float is in part interpreted; the expansion of rows to cells is not for that."""
    df = spark.range(10).select("id", (F.col("id") / 4).alias("x"), F.lit("a").alias("y"))
    plan = corpus.cells_of(df, "t", F.col("id"), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate explode" in line and "*(" in line], plan
