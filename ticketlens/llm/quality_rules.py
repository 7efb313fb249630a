"""Quality rules (operator 2): a threshold table compiled into one projection.

Every rule bounds one ratio of two counts of the text; ``compile_rules`` turns
the table into a single boolean expression, so all rules are one Spark
projection of built-in functions. Ratios are compared by cross-multiplication
in whole numbers, in parts per thousand.

Cases: a null or empty text has no words and fails the base rule. A rule whose
denominator is 0 passes (the base rule has already refused such a text).
Repeated rows are judged one by one; an empty table gives an empty table; extra
columns, whatever their names, are passed through by ``filter_documents`` and
never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import WORD_SPACE, WORD_SPACE_CLASS, let, words

#: The symbols that count, the words of a window, the base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
BASE_MIN_WORDS = 20
BASE_REPEAT_PERCENT = 30

#: Frequent function words of the corpus' languages (en, fr, de, es).
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his at from this are or an".split(),
    "fr": "le la les de des du et un une que qui en est pour dans par sur au avec ce il ne pas".split(),
    "de": "der die das den dem des und in zu von mit ist im sich auf für nicht ein eine als auch an".split(),
    "es": "el la los las de del que y en un una a se por con no su para al lo es como".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * count / base <= high``; a bound of None is open."""

    name: str
    count: str
    base: str
    low: int | None = None
    high: int | None = None


#: The threshold table. Counts are columns of ``text_counts``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbol_ratio", "n_symbols", "n_words", high=100),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300),
)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines",
)


def _repeat_words(word_list: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash over the hashes of their words. Texts
    without a repeated window (nearly all) stop after one hash-set pass; the
    others sort (hash, position) once, so the cost is n log n for any text.
    """
    n = F.size(word_list)

    def covered(positions: Column) -> Column:
        last = F.size(positions) - 1
        gains = F.transform(
            positions,
            lambda p, j: F.when(j < last, F.least(F.lit(window), F.get(positions, j + 1) - p)).otherwise(window),
        )
        return F.aggregate(gains, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(ordered: Column) -> Column:
        def at(i):
            return F.get(ordered, i)["h"]

        marked = F.transform(
            ordered,
            lambda s, i: F.when(
                ((i > 0) & (at(i - 1) == s["h"])) | F.coalesce(at(i + 1) == s["h"], F.lit(False)), s["p"]
            ),
        )
        return let(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), covered)

    def from_hashes(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), repeated)
        )

    def windows(word_hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(word_hashes) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(word_hashes, i, window)))

    hashed = let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda hs: let(windows(hs), from_hashes))
    return F.when(n <= window, F.lit(0).cast("long")).otherwise(hashed)


def text_counts(text: Column, stop_words: dict[str, list[str]] | None = None, window: int = WINDOW) -> Column:
    """Struct of the counts the rules use (``COUNTS``), all of type long."""
    stops = sorted({w for ws in (stop_words or STOP_WORDS).values() for w in ws})
    body = F.coalesce(text, F.lit(""))
    word_chars = F.length(F.translate(body, WORD_SPACE, ""))
    n_symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))
    lines = F.filter(F.split(body, "\n"), lambda ln: ln.rlike("[^ \\t\\n\\x0B\\f\\r]"))

    def long(c: Column, name: str) -> Column:
        return c.cast("long").alias(name)

    def with_lines(word_list: Column, line_list: Column) -> Column:
        return F.struct(
            long(F.size(word_list), "n_words"),
            long(word_chars, "word_chars"),
            long(n_symbols, "n_symbols"),
            long(F.size(line_list) - F.size(F.array_distinct(line_list)), "n_dup_lines"),
            long(_repeat_words(word_list, window), "n_repeat_words"),
            long(F.size(F.filter(word_list, lambda w: F.lower(w).isin(stops))), "n_stop_words"),
            long(F.size(line_list), "n_lines"),
            long(F.size(F.filter(line_list, lambda ln: ln.rlike(f"^{WORD_SPACE_CLASS}*[-*•]"))), "n_bullet_lines"),
            long(F.size(F.filter(line_list, lambda ln: ln.rlike("(\\.\\.\\.|…)$"))), "n_ellipsis_lines"),
        )

    return let(words(body), lambda ws: let(lines, lambda ls: with_lines(ws, ls)))


def compile_rules(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the failed rules, in table order, as one expression."""
    failed = []
    for r in rules:
        count, base = counts[r.count] * 1000, counts[r.base]
        out = F.lit(False)
        if r.low is not None:
            out = out | (count < base * r.low)
        if r.high is not None:
            out = out | (count > base * r.high)
        failed.append(F.when(out, F.lit(r.name)))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def judge(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the counts, ``base_failed``, ``failed_rules`` and ``kept`` for a text."""

    def verdict(c: Column) -> Column:
        base = (c["n_words"] < BASE_MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * BASE_REPEAT_PERCENT)
        failed = compile_rules(c, rules)
        return F.struct(
            *[c[name].alias(name) for name in COUNTS],
            base.alias("base_failed"),
            failed.alias("failed_rules"),
            (~base & (F.size(failed) == 0)).alias("kept"),
        )

    return let(text_counts(text), verdict)


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents the rules keep, with the columns they came with."""
    return docs.filter(judge(F.col(f"`{text}`"), rules)["kept"])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts and the verdict."""
    judged = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), judge(F.col(f"`{text}`")).alias("j"))
    return judged.select(
        "doc_id", *[F.col(f"j.{c}") for c in COUNTS], "j.base_failed", "j.kept",
        F.concat_ws(",", "j.failed_rules").alias("failed_rules"),
    )
