"""Markdown images and links to their text (T7, T8), in linear time.

A link is ``[text](target)`` where the target may hold one level of
parentheses. Backtracking engines look for the end of the target again from
every ``](``, which is quadratic on hostile text; here the walk from one
parenthesis to the next is remembered, so every character is looked at a
bounded number of times whatever the text. Spark has no built-in that can
remember, so the step is an Arrow-batched UDF; only values with ``](`` cross to
Python.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Functions travel to workers by value: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINK_MIDDLE = "]("
_PAREN = re.compile(r"[()]")


def _target_ends(text: str):
    """A function from the place of ``(`` to that of the ``)`` that ends the target, or -1."""
    closes = [m.start() for m in re.finditer(r"\)", text)]
    known: dict[int, int] = {}

    def end(opening: int) -> int:
        at, path = opening + 1, []
        while at not in known:
            path.append(at)
            paren = _PAREN.search(text, at)
            if paren is None:
                known[at] = -1
            elif paren[0] == ")":
                known[at] = paren.start()
            else:  # an inner pair ends at the next ")"
                k = bisect_right(closes, paren.start())
                if k == len(closes):
                    known[at] = -1
                else:
                    at = closes[k] + 1
                    continue
            break
        result = known[at]
        for p in path:
            known[p] = result
        return result

    return end


def strip_links(text: str, opener: str) -> str:
    """Replace ``opener text](target)`` by the stripped text; ``opener`` is ``![`` or ``[``.

    A link (not an image) needs at least one character between its brackets.
    """
    if LINK_MIDDLE not in text:
        return text
    target_end = _target_ends(text)
    out, kept, at = [], 0, 0
    while (start := text.find(opener, at)) >= 0:
        inner = start + len(opener)
        close = text.find("]", inner)
        if close < 0:
            break
        if opener == "[" and close == inner:
            at = inner
            continue
        end = target_end(close + 1) if text.startswith("(", close + 1) else -1
        if end < 0:  # every opener up to here meets the same "]"
            at = close + 1
            continue
        out += [text[kept:start], text[inner:close].strip()]
        kept = at = end + 1
    return "".join([*out, text[kept:]]) if out else text


def _udf(openers: tuple[str, ...]):
    @F.pandas_udf(StringType())
    def links_to_text(values: pd.Series) -> pd.Series:
        def one(text):
            if text is not None:
                for opener in openers:
                    text = strip_links(text, opener)
            return text

        return values.map(one, na_action="ignore")

    return links_to_text


_IMAGES, _LINKS, _BOTH = _udf(("![",)), _udf(("[",)), _udf(("![", "["))


def _guarded(udf, text: Column) -> Column:
    return F.coalesce(udf(F.when(text.contains(LINK_MIDDLE), text)), text)


def images_to_text(text: Column) -> Column:
    return _guarded(_IMAGES, text)


def links_to_text(text: Column) -> Column:
    return _guarded(_LINKS, text)


def images_and_links_to_text(text: Column) -> Column:
    """T7 then T8 in one pass to Python."""
    return _guarded(_BOTH, text)


def images_and_links_to_text_unguarded(text: Column) -> Column:
    """The same with one reference to ``text``, for single-expression chains."""
    return _BOTH(text)
