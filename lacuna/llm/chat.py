"""Chat formatting by schema fingerprints, with DataFrame operations only.

Records come as JSON, or as structs of the same fields, in different layouts: messages with roles, ShareGPT conversations,
prompts with completions, instructions with inputs and outputs, questions with answers. Of each record the nested
field paths that are present are listed, sorted and hashed; the fingerprint selects a declarative mapping
(``LAYOUTS``), and the mapping turns the record into canonical turns of role and text. Fields that no
mapping reads have no part in the fingerprint, so ids and other metadata do not disturb it.

The template marks each turn with a header and an end mark. Inside texts and roles the two control strings
and the escape character are replaced by escapes that contain none of them, so that the output can be
split and unescaped without loss. The loss mask is a list of character spans over the formatted text: the
texts of assistant turns, without their marks.

Roles stay as they are, but for the layouts whose own names for them are known (``Layout.role_names``).

Defined results: a null text or role is empty; a record that is null, not JSON, or of no known layout has
``layout`` null and no turns, and ``format_counts`` counts such records; content that is not a string is kept as its JSON
text. Texts have no greatest length but that of a string in Spark. One record is one row,
as its digest and its formatted text are, so memory is bounded by the longest conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacuna.llm.columns import fresh

HEADER, END, ESCAPE = "###", "</turn>", "\\"

#: The fields that mappings read, by JSON type.
RECORD = (
    "messages array<struct<role string, content string>>, conversations array<struct<from string, value string>>, "
    "system string, prompt string, completion string, response string, instruction string, input string, output string, question string, answer string"
)

#: JSON strings of any length are read; without this the parser gives up at 20,000,000 characters.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}

#: The canonical roles by their names in ShareGPT records.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping from present paths to turns. ``turns``: (role, fields joined by a blank line); ``each``: (array, role field, text field).

    ``role_names``: the canonical roles by the layout's own names, where they differ.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    role_names: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[tuple[str, ...]]:
        """The sets of paths that this layout covers: the required ones with any of the optional ones."""
        return [tuple(sorted(self.required + more)) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), ("system",), (("system", ("system",)),), ("messages", "role", "content")),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), ("system",), (("system", ("system",)),), ("conversations", "from", "value"), tuple(ROLE_NAMES.items())),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("system",), (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)

_FIELDS = ("system", "prompt", "completion", "response", "instruction", "input", "output", "question", "answer")
_ARRAYS = {"messages": ("role", "content"), "conversations": ("from", "value")}
_TURNS = "array<struct<role:string,text:string>>"


def _hash(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def _has(part: str, element: Column) -> Column:
    return element[part].isNotNull()


def field_paths(record: Column) -> Column:
    """The nested field paths that are present (not null) in a parsed record."""
    found = [F.when(record[f].isNotNull(), F.lit(f)) for f in _FIELDS]
    for name, parts in _ARRAYS.items():
        found += [F.when(F.exists(record[name], partial(_has, part)), F.lit(f"{name}[].{part}")) for part in parts]
    return F.array_compact(F.array(*found))


def _canonical_role(layout: Layout, role: Column) -> Column:
    if not layout.role_names:
        return F.coalesce(role, F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in layout.role_names for x in pair])
    return F.coalesce(names[F.lower(F.trim(role))], role, F.lit(""))


def _mapped(layout: Layout, record: Column) -> Column:
    """The canonical turns of a record of this layout."""
    parts = []
    for role, fields in layout.turns:
        texts = F.array_compact(F.array(*[F.when((F.length(record[f]) > 0) | F.lit(f in layout.required), F.coalesce(record[f], F.lit(""))) for f in fields]))
        turn = F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))
        parts.append(F.when(F.size(texts) > 0, F.array(turn)).otherwise(F.array().cast(_TURNS)))
    if layout.each:
        name, role, text = layout.each
        parts.append(F.transform(record[name], lambda x: F.struct(_canonical_role(layout, x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))))
    return F.concat(*parts)


def escape(text: Column) -> Column:
    r"""Replace the escape character by ``\b``, the header mark by ``\h`` and the end mark by ``\t``."""
    for string, sign in ((ESCAPE, "b"), (HEADER, "h"), (END, "t")):
        text = F.replace(text, F.lit(string), F.lit(ESCAPE + sign))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: an escaped escape character is never followed by ``h`` or ``t`` on its own."""
    for string, sign in ((END, "t"), (HEADER, "h"), (ESCAPE, "b")):
        text = F.replace(text, F.lit(ESCAPE + sign), F.lit(string))
    return text


def _header(role: Column) -> Column:
    return F.concat(F.lit(f"{HEADER} "), F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n")), F.lit("\n"))


def _parsed(df: DataFrame, record_col: str) -> Column:
    """A record column as a struct of all known fields: JSON is parsed, a struct keeps those it has."""
    found = df.schema[record_col].dataType
    if not isinstance(found, StructType):
        return F.from_json(F.col(record_col), RECORD, JSON_OPTIONS)
    known = StructType.fromDDL(RECORD)
    return F.struct(*[(F.col(record_col)[f.name] if f.name in found.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.fields])


def canonical_turns(df: DataFrame, record_col: str) -> DataFrame:
    """Add fingerprint, layout and turns to records in JSON or in structs; columns of these names are replaced, others are kept."""
    inner = fresh(df, "__record")
    record = F.col(inner)
    known = {_key(p): x for x in LAYOUTS for p in x.fingerprints()}
    names = F.create_map(*[F.lit(x) for key, found in known.items() for x in (key, found.name)])
    parsed = df.withColumn(inner, _parsed(df, record_col)).withColumn("fingerprint", _hash(field_paths(record)))
    layout = names[F.col("fingerprint")]
    none = F.array().cast(_TURNS)
    turns = reduce(lambda rest, x: F.when(F.col("layout") == x.name, _mapped(x, record)).otherwise(rest), LAYOUTS, none)
    return parsed.withColumn("layout", layout).withColumn("turns", turns).drop(inner)


def _key(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def render(df: DataFrame) -> DataFrame:
    """Add formatted (the text) and loss_spans (start and length in code points) to canonical turns."""
    pieces = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), _header(t["role"]).alias("header"), escape(t["text"]).alias("body")))
    mark = F.lit(f"{END}\n")
    whole = F.array_join(F.transform("__pieces", lambda p: F.concat(p["header"], p["body"], mark)), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["header"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("length"))
        spans = F.when(p["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((start + F.length(p["body"]) + len(END) + 1).alias("at"), spans.alias("spans"))

    out = df.withColumn("__pieces", pieces).withColumn("formatted", whole)
    return out.withColumn("loss_spans", F.aggregate("__pieces", zero, step)["spans"]).drop("__pieces")


def format_chats(df: DataFrame, record_col: str) -> DataFrame:
    """Add fingerprint, layout, turns, formatted and loss_spans to records of any known layout."""
    return render(canonical_turns(df, record_col))


def format_counts(df: DataFrame, record_col: str) -> DataFrame:
    """How many records each layout has; those that no mapping reads are counted under a null layout."""
    return canonical_turns(df, record_col).groupBy("layout").agg(F.count(F.lit(1)).alias("n_records"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.split(formatted, f"{END}\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        end = F.locate("\n", piece)
        role = F.substring(piece, F.lit(len(HEADER) + 2), end - (len(HEADER) + 2))
        text = F.substring(piece, end + 1, F.length(piece))
        return F.struct(unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversation_records(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record (a struct of messages) per conversation from rows of turns; ties in ``turn`` follow role and text."""
    message = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = df.groupBy(F.col(id_col).alias(id_col)).agg(F.array_sort(F.collect_list(message)).alias("__messages"))
    record = F.struct(F.transform("__messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    return rows.select(id_col, record.alias("record"))


def conversation_digests(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Format conversations given as rows of turns, and digest what is read back from the output."""
    made = format_chats(conversation_records(df, id_col), "record").select(id_col, "formatted", "loss_spans")
    back = made.withColumn("__turns", read_turns(F.col("formatted"))).withColumn("__loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        id_col,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
