"""Chat formatting (operator 8): any known layout to one marked-up text.

A layout is recognised by its schema fingerprint: the hash of the sorted nested
field paths (of those any mapping knows; other columns, whatever they are
called, do not change it). The fingerprint selects a declarative mapping, which
turns the row into canonical turns ``array<struct<role, text>>``, or says which
columns of a turn-per-row table are role, text and place. Typed tables have one
fingerprint (from the schema), and tables of several layouts are formatted
together; JSON rows have one each, so rows of several layouts may be mixed.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts
every ``<`` followed by any number of backslashes and ``|`` gets one more
backslash, so no marker can appear in a text and the change can be undone.
Inside roles ``%``, newline and ``<`` are percent-escaped.

Cases: a null role or text is empty; a null conversation id is a conversation
of its own; turns with the same number are ordered by role and text; repeated
rows are repeated turns; an empty table gives an empty table; a JSON row of an
unknown layout or invalid JSON gives no turns and ``layout`` null. A
conversation is one output record, so its turns meet in one row: a record is
the unit of the result and its size that of the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import let

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role: string, text: string>>"
#: Names that other layouts use for the canonical roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths and how a JSON row of it becomes turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]


@dataclass(frozen=True)
class RowMapping:
    """A layout with one row per turn: its field paths and which column says what."""

    name: str
    paths: tuple[str, ...]
    role: str
    text: str
    turn: str


def _field(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _fixed(*fields: tuple[str, str]) -> Callable[[Column], Column]:
    def build(v: Column) -> Column:
        return F.array(*[F.struct(F.lit(r).alias("role"), _field(v, p).alias("text")) for r, p in fields])

    return build


def _listed(path: str, role: str, text: str) -> Callable[[Column], Column]:
    def build(v: Column) -> Column:
        items = F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(items, lambda m: F.struct(canonical_role(_field(m, role)).alias("role"), _field(m, text).alias("text")))

    return build


def _alpaca(v: Column) -> Column:
    extra = _field(v, "input")
    ask = F.concat(_field(v, "instruction"), F.when(extra == "", "").otherwise(F.concat(F.lit("\n\n"), extra)))
    return F.array(
        F.struct(F.lit("user").alias("role"), ask.alias("text")),
        F.struct(F.lit("assistant").alias("role"), _field(v, "output").alias("text")),
    )


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), _listed("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Mapping("prompt_completion", ("completion", "prompt"), _fixed(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), _fixed(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"),
            _fixed(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"), _fixed(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), _alpaca),
    Mapping("instruction_input", ("input", "instruction", "output"), _alpaca),
)
#: Tables with one row per turn: field paths and the columns that hold role, text and place of the turn.
ROW_MAPPINGS = (
    RowMapping("turn_rows", ("role", "text", "turn"), "role", "text", "turn"),
    RowMapping("message_rows", ("content", "position", "role"), "role", "content", "position"),
    RowMapping("speaker_rows", ("index", "speaker", "utterance"), "speaker", "utterance", "index"),
)
KNOWN_PATHS = sorted({p for m in (*MAPPINGS, *ROW_MAPPINGS) for p in m.paths})


def _hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {_hash(m.paths): m for m in (*MAPPINGS, *ROW_MAPPINGS)}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; an array element is written ``[]``."""
    if isinstance(schema, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{dot}{f.name}")]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def table_fingerprint(schema: T.StructType) -> str:
    """Fingerprint of a typed table: its paths, reduced to those a mapping knows."""
    return _hash(set(schema_paths(schema)) & set(KNOWN_PATHS))


def json_fingerprint(v: Column) -> Column:
    """Fingerprint of a JSON row (VARIANT). Paths are at most two levels deep."""
    top = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")), F.array().cast("array<string>"))

    def below(key: str) -> Column:
        items = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<map<string, variant>>"), F.array().cast("array<map<string, variant>>"))
        names = F.array_distinct(F.flatten(F.transform(items, F.map_keys)))
        return F.transform(names, lambda n: F.concat(F.lit(f"{key}[]."), n))

    nested = [below(k) for k in sorted({p.split("[]")[0] for p in KNOWN_PATHS if "[]" in p})]
    known = F.array_intersect(F.array(*[F.lit(p) for p in KNOWN_PATHS]), F.concat(top, *nested))
    return F.sha2(F.array_join(known, "\n"), 256)


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, role), role)


def turns_from_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` plus ``fingerprint``, ``layout`` and ``turns`` of a JSON string column."""
    v = F.try_parse_json(F.col(f"`{column}`"))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for print_, m in FINGERPRINTS.items():
        if isinstance(m, RowMapping):
            continue  # a JSON row is a whole conversation
        layout = F.when(F.col("fingerprint") == print_, F.lit(m.name)).otherwise(layout)
        turns = F.when(F.col("fingerprint") == print_, m.turns(F.col("_row")).cast(TURNS)).otherwise(turns)
    out = df.withColumn("_row", v).withColumn("fingerprint", F.when(F.col("_row").isNotNull(), json_fingerprint(F.col("_row"))))
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("_row")


# --- escaping and marking -------------------------------------------------------


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*+)\\|", "<$1\\\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\\\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    for raw, mark in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(mark))
    return role


def unescape_role(role: Column) -> Column:
    for raw, mark in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(mark), F.lit(raw))
    return role


def mark_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape_text(text), F.lit(END))


def format_turns(turns: Column) -> Column:
    """The formatted text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: mark_turn(t["role"], t["text"])), "")


def parse(formatted: Column) -> Column:
    """The turns read back from a formatted text."""
    pieces = F.filter(F.split(formatted, "<\\|im_end\\|>\\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(START) + 1), cut - F.lit(len(START) + 1))
        text = F.substring(piece, cut + 1, F.length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"))

    return F.transform(pieces, turn)


def turn_rows(table: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role and text (canonical role, no nulls in role and text) of a typed table of any known layout.

    The fingerprint of the table's schema, the id column left out, selects the
    mapping. Where columns of other layouts stand beside those of one, so that
    no fingerprint fits, the layout with most of its paths there is taken (ties:
    the first, layouts with a row per turn before others); a table that holds no
    layout raises a ValueError.
    """
    layout = T.StructType([f for f in table.schema.fields if f.name != conv_id])
    mapping = FINGERPRINTS.get(table_fingerprint(layout))
    if mapping is None:
        held = [m for m in (*ROW_MAPPINGS, *MAPPINGS) if set(m.paths) <= set(schema_paths(layout))]
        mapping = max(held, key=lambda m: len(m.paths), default=None)
    key = F.col(f"`{conv_id}`").alias("conv_id")
    if mapping is None:
        raise ValueError(f"no mapping for a table with {sorted(schema_paths(layout))}")
    if isinstance(mapping, RowMapping):
        flat = table.select(
            key, F.col(f"`{mapping.turn}`").cast("long").alias("turn"), F.col(f"`{mapping.role}`").alias("role"),
            F.col(f"`{mapping.text}`").alias("text"),
        )
    else:
        fields = sorted({p.split("[]")[0] for p in mapping.paths})
        row = F.to_variant_object(F.struct(*[F.col(f"`{f}`").alias(f) for f in fields]))
        turns = table.select(key, F.posexplode_outer(mapping.turns(row).cast(TURNS)).alias("turn", "t"))
        flat = turns.filter("t IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    role = canonical_role(F.coalesce(F.col("role"), F.lit("")))
    return flat.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_conversations(
    *tables: DataFrame, conv_id: str = "conv_id", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation of tables of any known layouts (see ``turn_rows``).

    Returns conv_id, ``formatted`` (the whole text), ``loss_turns`` (per turn:
    does it train the model) and ``loss_spans``: start and end, in code points
    of ``formatted``, of the texts under the loss mask.
    """
    flat = reduce(DataFrame.unionByName, [turn_rows(t, conv_id) for t in tables])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = (
        flat.select(
            "*",
            F.row_number().over(order).alias("n"),
            mark_turn(F.col("role"), F.col("text")).alias("piece"),
            F.col("role").isin(*loss_roles).alias("loss"),
        )
        .withColumn("stop", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last", F.col("stop") - len(END))
        .withColumn("first", F.col("last") - F.length(escape_text(F.col("text"))))
    )
    # The window has already brought a conversation together: no further shuffle.
    grouped = marked.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "piece", "loss", "first", "last"))).alias("t")
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.col("t.loss").alias("loss_turns"),
        F.transform(
            F.filter("t", lambda x: x["loss"]),
            lambda x: F.struct(x["first"].alias("start"), x["last"].alias("end")),
        ).alias("loss_spans"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back, as counts and SHA-256 digests."""

    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    def of(turns: Column, mask: Column) -> Column:
        whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        learned = F.array_join(F.transform(F.filter(turns, lambda t, i: F.get(mask, i)), lambda t: t["text"]), "")
        return let(
            learned,
            lambda l: F.struct(
                F.size(turns).cast("long").alias("n_turns"),
                sha(whole).alias("turns_sha256"),
                F.length(l).cast("long").alias("loss_chars"),
                sha(l).alias("loss_sha256"),
            ),
        )

    read = let(F.col("loss_turns"), lambda mask: let(parse(F.col("formatted")), lambda turns: of(turns, mask)))
    return formatted.select(
        "conv_id", read.alias("d"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "d.n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "formatted_chars")
