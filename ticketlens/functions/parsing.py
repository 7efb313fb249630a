"""Scalar parsers: zone-aware timestamps, issue references, issue identity."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.fixed_values import SAMPLE_ID_PREFIX

# An ISO-8601 string with a zone: extended or basic date and time, "T" or a blank
# between them, any number of fraction digits (six count), and "Z" or an offset
# of hours, minutes, seconds.
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8})"
_TIME = r"(\d{2}(?::\d{2}(?::\d{2})?)?|\d{4}|\d{6})(?:(?<=\d{2}:\d{2}:\d{2}|\d{6})[.,](\d+))?"
_OFFSET = r"(Z|[+-](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d)?|[0-5]\d(?:[0-5]\d)?)?)"
ZONED = "^" + _DATE + "[T ]" + _TIME + _OFFSET + r"\z"


def unix_micros(text: Column) -> Column:  # T21
    """Zoned ISO-8601 text -> microseconds since the epoch; naive or invalid -> NULL."""

    def parsed(value: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(value, ZONED, i)

        digits = F.rpad(F.replace(part(2), F.lit(":"), F.lit("")), 6, "0")
        day = F.replace(part(1), F.lit("-"), F.lit(""))
        fraction = F.rpad(F.left(part(3), F.lit(6)), 6, "0")

        def cut(c: Column, at: int, size: int) -> Column:
            return F.substring(c, at, size)

        plain = F.concat(
            cut(day, 1, 4), F.lit("-"), cut(day, 5, 2), F.lit("-"), cut(day, 7, 2), F.lit("T"),
            cut(digits, 1, 2), F.lit(":"), cut(digits, 3, 2), F.lit(":"), cut(digits, 5, 2), F.lit("."), fraction, F.lit("Z"),
        )
        off = F.rpad(F.regexp_replace(part(4), "[Z:+-]", ""), 6, "0")
        seconds = sum(
            (cut(off, at, 2).cast("long") * scale for at, scale in ((1, 3600), (3, 60), (5, 1))), F.lit(0).cast("long")
        )
        signed = F.when(part(4).startswith("-"), -seconds).otherwise(seconds)
        return F.unix_micros(F.try_to_timestamp(plain)) - signed * 1_000_000

    # The input is read once, as a lambda variable.
    return F.element_at(F.transform(F.array(text), lambda v: F.when(v.rlike(ZONED), parsed(v))), 1)


def parse_utc(text: Column) -> Column:
    """Zoned ISO-8601 text -> TIMESTAMP (an instant)."""
    return F.timestamp_micros(unix_micros(text))


# owner/repo#123 with nothing else around it (surrounding blanks are trimmed).
# Any decimal digits count; a number beyond BIGINT is no reference.
ISSUE_REFERENCE = r"(?U)^([^/\s]+)/([^#\s]+)#(\d+)$"
_DIGITS = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def parse_issue_reference(ref: Column) -> Column:  # T23
    """STRUCT(owner, repo, number) or NULL when the text is not a reference."""
    trimmed = F.regexp_replace(ref, r"(?U)^\s+|\s+\z", "")
    part = lambda i: F.regexp_extract(trimmed, ISSUE_REFERENCE, i)
    number = F.translate(part(3), _DIGITS, _ASCII_DIGITS).try_cast("bigint")
    return F.when(
        trimmed.rlike(ISSUE_REFERENCE) & number.isNotNull(),
        F.struct(part(1).alias("owner"), part(2).alias("repo"), number.alias("number")),
    )


def sample_id(number: Column) -> Column:  # T22
    return F.concat(F.lit(SAMPLE_ID_PREFIX), number.cast("string"))


def issue_url(html_url: Column, number: Column, repository: str) -> Column:  # T22
    default = F.concat(F.lit(f"https://github.com/{repository}/issues/"), number.cast("string"))
    return F.coalesce(html_url, default)
