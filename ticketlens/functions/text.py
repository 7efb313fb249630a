"""Text contract: cleaning of issue titles and bodies as Column expressions.

Every function maps a Column to a Column, so the same code runs in batch and
streaming plans. The steps are built-in expressions but for Unicode NFKC
(``unicode.py``, non-ASCII values only) and markdown links (``markdown.py``,
values with ``](`` only), which are Arrow-batched. Steps guarded by a lambda
run interpreted, outside whole-stage codegen; that costs less than sending
every value through the regex engine.

Every step is linear in its text, also on hostile input (unclosed brackets,
comments, tags, runs of backticks), without any length limit.

Patterns are Java regular expressions. Notes on the choices:

* A word boundary after a command, a number or a hex word is spelled out as "no
  letter, number or underscore follows": Java's ``\\b`` also counts combining
  marks as word characters, the contract does not.
* ``(?iu)`` gives Unicode case folding; a digit is ``\\p{Nd}``.
* Whitespace is the contract's own set (Python's ``str.isspace``: it includes
  U+001C..U+001F, which Java's ``\\s`` does not), spelled out as a class.
* ``(?d)`` makes ``\\n`` the only line terminator for ``^`` and ``$``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    ISSUE_REF_PLACEHOLDER,
    TRIAGE_COMMANDS,
    URL_PLACEHOLDER,
)
from ticketlens.functions.markdown import (
    images_and_links_to_text,
    images_and_links_to_text_unguarded,
    images_to_text,
    links_to_text,
)
from ticketlens.functions.unicode import nfkc

# Whitespace as the text contract means it (Python's str.isspace), derived by
# rule, as a Java character class and as a plain string for btrim.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WS_BODY = "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE)
WS = "[" + _WS_BODY + "]"


def java_quote(text: str) -> str:
    """Escape every non-alphanumeric character (always legal in Java regex)."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in text)


def _longest_first(names: Iterable[str]) -> list[str]:
    return sorted(set(names), key=lambda name: (-len(name), name))


def command_alternation(commands: Iterable[str] = TRIAGE_COMMANDS) -> str:
    return "|".join(java_quote(c) for c in _longest_first(commands))


_CMDS = command_alternation()

# T2..T15 patterns (Java). (?iu) where case folding must be Unicode-aware.
WORD = r"[\p{L}\p{N}_]"
WORD_ENDS = r"(?!" + WORD + ")"
CRLF = r"\r\n?"
HTML_COMMENT = r"(?s)<!--.*?-->"
COMMAND_LINE = (
    r"(?imdu)^[ \t]*+(?:>[ \t]*+)*+"
    r"(?:(?:[-*+]|\p{Nd}+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)?"
    r"`{0,3}[ \t]*/(?:" + _CMDS + r")" + WORD_ENDS + r"[^\n]*(?:\n|$)"
)
# A run of backticks is entered at its start only and taken whole.
INLINE_COMMAND = r"(?iu)(?<!`)`++[ \t]*+/(?:" + _CMDS + r")" + WORD_ENDS + r"[^`\r\n]*+`++"
HTML_BR = r"(?iu)<br" + WS + r"*+/?>"
HTML_TAG = r"<[^>]++>"
RAW_URL = r"(?iu)https?://[^" + _WS_BODY + r"<>()\]]+"
# '#' first so most positions fail on one char; the look-behind then checks
# the character before the '#'.
ISSUE_REF = r"#(?<![A-Za-z0-9]#)\p{Nd}++" + WORD_ENDS
EMPTY_BRACKETS = r"\[" + WS + r"*+\]|\(" + WS + r"*+\)"
# Runs of two or more blanks, or any run with a tab (a lone space is kept as is).
SPACE_RUN = r"\t[ \t]*| [ \t]+"
CONTROL = r"[\x00-\x08\x0B-\x1F]"


def label_mention_pattern(labels: Iterable[str]) -> str | None:
    """One alternation over the catalog, or None for an empty catalog.

    A mention is ``tax/name``, ``tax%2Fname`` or ``tax[-_:]name`` (plus
    ``@?kubernetes/sig-name(-suffix)?`` for sig labels), not glued to ASCII
    alphanumerics. Names are tried longest first within each taxonomy.
    """
    by_taxonomy: dict[str, list[str]] = {}
    for label in set(labels):
        taxonomy, _, name = label.partition("/")
        by_taxonomy.setdefault(taxonomy, []).append(name)
    if not by_taxonomy:
        return None
    branches = []
    for taxonomy in sorted(by_taxonomy):
        names = "|".join(java_quote(n) for n in _longest_first(by_taxonomy[taxonomy]))
        branches.append(f"{java_quote(taxonomy)}(?:/|%2[fF]|[-_:])(?:{names})")
        if taxonomy == "sig":
            branches.append(f"@?kubernetes/sig-(?:{names})(?:-[a-z0-9-]+)?")
    return r"(?iu)(?<![A-Za-z0-9])(?:" + "|".join(branches) + r")(?![A-Za-z0-9])"


# --- single steps (T0..T15) -------------------------------------------------
# Every step reads its input exactly once, so the composed chain stays linear
# in size under any optimizer rewrite (projection collapse, predicate
# pushdown). A step that needs a literal is guarded by a substring test inside
# a lambda (the input is still read once): rows without the literal skip the
# regex engine and its UTF-8/UTF-16 round trip. Patterns put a literal first
# where possible and avoid Java's slow Unicode mode.


def _when_contains(text: Column, needle, step) -> Column:
    """``step(text)`` if ``text`` contains ``needle`` (or any of several), else
    ``text`` -- one read of ``text``."""
    needles = (needle,) if isinstance(needle, str) else tuple(needle)

    def found(v):
        cond = v.contains(needles[0])
        for n in needles[1:]:
            cond = cond | v.contains(n)
        return cond

    guarded = F.transform(F.array(text), lambda v: F.when(found(v), step(v)).otherwise(v))
    return F.element_at(guarded, 1)


# Every label-mention form holds one of these: "/" (tax/name, kubernetes/sig-),
# "%" (tax%2Fname) or one of "-_:" (tax-name, tax_name, tax:name).
LABEL_MENTION_CHARS = ("/", "%", "-", "_", ":")


def blank_if_null(text: Column) -> Column:  # T0
    return F.coalesce(text, F.lit(""))


def normalize_newlines(text: Column) -> Column:  # T2
    no_cr = _when_contains(text, "\r", lambda v: F.regexp_replace(v, CRLF, "\n"))
    return _when_contains(no_cr, "\x00", lambda v: F.regexp_replace(v, r"\x00", " "))


def _up_to_last(text: Column, closing: str, step) -> Column:
    """``step`` on the text up to the last ``closing``: beyond it nothing can match,
    and before it every opening finds its end, so no search runs to the end in vain."""
    tail = F.substring_index(text, closing, -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.concat(step(head), tail)


def strip_html_comments(text: Column) -> Column:  # T3
    return _when_contains(
        text, "<!--", lambda v: _up_to_last(v, "-->", lambda h: F.regexp_replace(h, HTML_COMMENT, " "))
    )


def strip_command_lines(text: Column) -> Column:  # T4
    return _when_contains(text, "/", lambda v: F.regexp_replace(v, COMMAND_LINE, "\n"))


def strip_inline_commands(text: Column) -> Column:  # T5
    return _when_contains(text, "`", lambda v: F.regexp_replace(v, INLINE_COMMAND, " "))


def mask_label_mentions(text: Column, labels: Iterable[str]) -> Column:  # T6
    pattern = label_mention_pattern(labels)
    if pattern is None:
        return text
    return _when_contains(text, LABEL_MENTION_CHARS, lambda v: F.regexp_replace(v, pattern, " "))


def strip_md_images(text: Column) -> Column:  # T7
    return images_to_text(text)


def strip_md_links(text: Column) -> Column:  # T8
    return links_to_text(text)


def strip_md(text: Column) -> Column:  # T7 + T8
    return images_and_links_to_text(text)


def strip_html(text: Column) -> Column:  # T9 + T10
    def tags(v):
        return F.regexp_replace(F.regexp_replace(v, HTML_BR, "\n"), HTML_TAG, " ")

    return _when_contains(text, "<", lambda v: _up_to_last(v, ">", tags))


def mask_urls(text: Column) -> Column:  # T11
    return _when_contains(text, "://", lambda v: F.regexp_replace(v, RAW_URL, URL_PLACEHOLDER))


def mask_issue_refs(text: Column) -> Column:  # T12
    return _when_contains(text, "#", lambda v: F.regexp_replace(v, ISSUE_REF, ISSUE_REF_PLACEHOLDER))


def strip_empty_brackets(text: Column) -> Column:  # T13
    return F.regexp_replace(text, EMPTY_BRACKETS, " ")


def strip_control(text: Column) -> Column:  # T14
    return F.regexp_replace(text, CONTROL, " ")


def collapse_blanks(text: Column) -> Column:  # T15, first half
    return F.regexp_replace(text, SPACE_RUN, " ")


def strip_lines(text: Column) -> Column:  # T15, second half
    """Strip every line, drop empty lines, join with newlines (the result is stripped)."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(PY_WHITESPACE)))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def normalize_lines(text: Column) -> Column:  # T15
    return strip_lines(collapse_blanks(text))


# --- composites ---------------------------------------------------------------


def steps(labels: Iterable[str] = ()) -> list:
    """T2..T15 in contract order, each ``Column -> Column``."""
    labels = tuple(labels)
    return [
        normalize_newlines,
        strip_html_comments,
        strip_command_lines,
        strip_inline_commands,
        lambda c: mask_label_mentions(c, labels),
        strip_md,
        strip_html,
        mask_urls,
        mask_issue_refs,
        strip_empty_brackets,
        strip_control,
        collapse_blanks,
        strip_lines,
    ]


def clean_field(text: Column, labels: Iterable[str] = ()) -> Column:  # T16
    """The whole cleaning contract, T0..T15 in order, as one expression."""
    value = nfkc(blank_if_null(text))
    for step in steps(labels):
        value = (images_and_links_to_text_unguarded if step is strip_md else step)(value)
    return value


def apply_steps(df: DataFrame, outputs: dict[str, Column], step_list, start=None) -> DataFrame:
    """Run ``step_list`` over each output column, one projection per step."""
    first = start or (lambda c: c)
    df = df.withColumns({name: first(col) for name, col in outputs.items()})
    for step in step_list:
        df = df.withColumns({name: step(F.col(name)) for name in outputs})
    return df


def clean_columns(df: DataFrame, outputs: dict[str, Column], labels: Iterable[str] = ()) -> DataFrame:  # T16
    """Add cleaned text columns (name -> raw text expression) to ``df``."""
    return apply_steps(df, outputs, steps(labels), start=lambda c: nfkc(blank_if_null(c)))


def model_input(clean_title: Column, clean_body: Column) -> Column:  # T17
    """``Title: <t>\\nBody: <b>`` right-stripped, from already cleaned fields.

    Cleaned fields never end in whitespace, so the right strip only removes
    the blank after ``Body:`` when the body is empty.
    """
    body_part = F.when(clean_body != "", F.concat(F.lit(" "), clean_body)).otherwise(F.lit(""))
    return F.concat(F.lit("Title: "), clean_title, F.lit("\nBody:"), body_part)


TITLE_KEY_STEPS = [
    lambda c: F.lower(nfkc(c)),
    lambda c: F.regexp_replace(c, r"https?://[^" + _WS_BODY + "]+", " "),
    lambda c: F.regexp_replace(c, r"(?<!" + WORD + r")[0-9a-f]{8,}+" + WORD_ENDS, " "),
    lambda c: F.regexp_replace(c, r"\p{Nd}+", " "),
    lambda c: F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " ")),
]


def title_key(clean_title: Column) -> Column:  # T18, one expression
    """Grouping key of a cleaned title: NFKC, lower, URLs/hex words/digits out,
    other non-[a-z0-9] runs to one blank, stripped."""
    value = clean_title
    for step in TITLE_KEY_STEPS:
        value = step(value)
    return value


def add_title_key(df: DataFrame, source: str, name: str) -> DataFrame:  # T18, one projection per step
    return apply_steps(df, {name: F.col(source)}, TITLE_KEY_STEPS)


def split_group_id(key: Column, number: Column) -> Column:  # T19
    """``grp_`` + 16 hex of SHA-256 of the key (``issue-<n>`` for an empty key).

    ``key`` is referenced once, so an expensive key expression runs once. An
    issue with neither key nor number cannot be built (``invalid_issues``).
    """
    seed = F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("issue-"), number.cast("string")))
    gid = F.concat(F.lit("grp_"), F.substring(F.sha2(seed, 256), 1, 16))
    # Never NULL (a digest of a non-null string); saying so lets Catalyst fold
    # the IS NOT NULL filter a join on this key infers, which would otherwise
    # be pushed below the projections and evaluate the key a second time.
    return F.coalesce(gid, F.lit("grp_"))
