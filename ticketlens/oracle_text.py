"""DuckDB (RE2) forms of the text contract, for oracle SQL only.

RE2 has no look-around and no possessive loops, so these are rewrites:
look-behind/ahead become captured neighbours put back by the replacement
(applied twice where one separator can be shared by two matches), and the
line normalisation is the literal split/transform/filter/join. RE2's ``\\s``
is ASCII, so Python's whitespace set is spelled out.
"""

from __future__ import annotations

from collections.abc import Iterable

from ticketlens.fixed_values import TRIAGE_COMMANDS

# Python's str.isspace() set, as RE2 class content.
PYWS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = "[" + PYWS + "]"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _re_quote(text: str) -> str:
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in text)


def _longest_first(names: Iterable[str]) -> list[str]:
    return sorted(set(names), key=lambda n: (-len(n), n))


CMDS = "|".join(_re_quote(c) for c in _longest_first(TRIAGE_COMMANDS))


def rx(expr: str, pattern: str, repl: str, repl_is_sql: bool = False) -> str:
    r = repl if repl_is_sql else q(repl)
    return f"regexp_replace({expr}, {q(pattern)}, {r}, 'g')"


def t_newlines(e):
    return rx(rx(e, r"\r\n?", "chr(10)", True), r"\x00", " ")


def t_comments(e):
    return rx(e, r"(?s)<!--.*?-->", " ")


def t_command_lines(e):
    pat = (r"(?im)^[ \t]*(?:>[ \t]*)*(?:(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)?"
           r"`{0,3}[ \t]*/(?:" + CMDS + r")\b[^\n]*(?:\n|$)")
    return rx(e, pat, "chr(10)", True)


def t_inline_commands(e):
    return rx(e, r"(?i)`+[ \t]*/(?:" + CMDS + r")\b[^`\r\n]*`+", " ")


def label_branches(labels: Iterable[str]) -> str | None:
    by_tax: dict[str, list[str]] = {}
    for label in set(labels):
        tax, _, name = label.partition("/")
        by_tax.setdefault(tax, []).append(name)
    if not by_tax:
        return None
    out = []
    for tax in sorted(by_tax):
        names = "|".join(_re_quote(n) for n in _longest_first(by_tax[tax]))
        out.append(f"{_re_quote(tax)}(?:/|%2[fF]|[-_:])(?:{names})")
        if tax == "sig":
            out.append(f"@?kubernetes/sig-(?:{names})(?:-[a-z0-9-]+)?")
    return "|".join(out)


def t_labels(e, labels):
    branches = label_branches(labels)
    if branches is None:
        return e
    pat = r"(?i)(^|[^A-Za-z0-9])(?:" + branches + r")([^A-Za-z0-9]|$)"
    return rx(rx(e, pat, r"\1 \2"), pat, r"\1 \2")


_TARGET = r"\((?:[^()]|\([^)]*\))*\)"


def t_images(e):
    return rx(e, r"!\[" + WS + r"*([^\]]*?)" + WS + r"*\]" + _TARGET, r"\1")


def t_links(e):
    pat = (r"\[(?:" + WS + r"+([^\]]*?)|([^\]" + PYWS + r"][^\]]*?))" + WS + r"*\]" + _TARGET)
    return rx(e, pat, r"\1\2")


def t_html(e):
    return rx(rx(e, r"(?i)<br" + WS + r"*/?>", "chr(10)", True), r"<[^>]+>", " ")


def t_urls(e):
    return rx(e, r"(?i)https?://[^" + PYWS + r"<>()\]]+", "<URL>")


def t_issue_refs(e):
    return rx(e, r"(^|[^A-Za-z0-9])#[0-9]+\b", r"\1<ISSUE_REF>")


def t_empty_brackets(e):
    return rx(e, r"\[" + WS + r"*\]|\(" + WS + r"*\)", " ")


def t_control(e):
    return rx(e, r"[\x01-\x08\x0b-\x1f]", " ")


def t_lines(e):
    line = rx(rx("l", r"[ \t]+", " "), "^" + WS + "+|" + WS + "+$", "")
    return (f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), "
            f"lambda l: {line}), lambda l: l <> ''), chr(10))")


def clean(e: str, labels: Iterable[str] = ()) -> str:
    v = f"coalesce({e}, '')"
    v = t_newlines(v)
    v = t_comments(v)
    v = t_command_lines(v)
    v = t_inline_commands(v)
    v = t_labels(v, labels)
    v = t_images(v)
    v = t_links(v)
    v = t_html(v)
    v = t_urls(v)
    v = t_issue_refs(v)
    v = t_empty_brackets(v)
    v = t_control(v)
    return t_lines(v)


def model_input(t: str, b: str) -> str:
    return f"concat('Title: ', {t}, chr(10), 'Body:', CASE WHEN {b} <> '' THEN concat(' ', {b}) ELSE '' END)"


_WORD = r"[\pL\pN_]"


def title_key(e: str) -> str:
    v = f"lower({e})"
    v = rx(v, r"https?://[^" + PYWS + "]+", " ")
    hexw = r"(^|[^\pL\pN_])[0-9a-f]{8,}([^\pL\pN_]|$)"
    v = rx(rx(v, hexw, r"\1 \2"), hexw, r"\1 \2")
    v = rx(v, r"\p{Nd}+", " ")
    v = rx(v, r"[^a-z0-9]+", " ")
    return f"trim({v})"


def group_id(key: str, number: str) -> str:
    return (f"concat('grp_', left(sha256(CASE WHEN {key} <> '' THEN {key} "
            f"ELSE concat('issue-', CAST({number} AS VARCHAR)) END), 16))")
