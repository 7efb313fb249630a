"""Exact order statistics of a long column, without sorting or gathering rows.

``percentile`` keeps every distinct value in one aggregation buffer, which does
not survive a third of 100 TB landing on one day. Here the wanted ranks are
located by drilling down through buckets (day, second, microsecond): each level
is one distributed count per bucket below at most a few parent buckets, ranked
by a window over that bounded table, and only the located buckets (one row per
rank) come back as literals for the next level. So there is one scan per level
and no join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (86_400_000_000, 1_000_000, 1)  # bucket widths in microseconds


def values_at(rows: DataFrame, col: str, ranks: Iterable[int] = (), count_only: bool = False, ranks_of=None):
    """(row count, {rank: (value, rows before it)}) of a long column; NULLs are left out.

    ``ranks_of`` may derive the ranks from the count, which the first level finds.
    """
    v = rows.select(F.col(col).cast("long").alias("v")).where(F.col("v").isNotNull())
    # Level 1: one row per day of the calendar.
    days = sorted((r["b"], r["count"]) for r in v.groupBy(F.expr(f"floor(v / {LEVELS[0]})").alias("b")).count().collect())
    total = sum(c for _, c in days)
    wanted = sorted(set(ranks if ranks_of is None else ranks_of(total)))
    found: dict[int, tuple[int, int]] = {}
    before = 0
    for bucket, count in days:
        for rank in wanted:
            if before <= rank < before + count:
                found[rank] = (bucket, before)
        before += count
    if count_only or not found:
        return total, {}
    for coarse, fine in zip(LEVELS, LEVELS[1:]):
        parents = sorted({b for b, _ in found.values()})
        counts = (
            v.where(F.expr(f"floor(v / {coarse})").isin(parents))
            .groupBy(F.expr(f"floor(v / {coarse})").alias("p"), F.expr(f"floor(v / {fine})").alias("b")).count()
        )
        upto = F.sum("count").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.select("p", "b", (upto - F.col("count")).alias("start"), upto.alias("stop"))
        hit = F.lit(False)
        for rank, (bucket, start) in found.items():
            hit = hit | ((F.col("p") == bucket) & (F.col("start") <= rank - start) & (F.col("stop") > rank - start))
        located = ranked.where(hit).collect()  # at most one row per rank
        found = {
            rank: next((r["b"], start + r["start"]) for r in located
                       if r["p"] == bucket and r["start"] <= rank - start < r["stop"])
            for rank, (bucket, start) in found.items()
        }
    return total, found


def nth_value(rows: DataFrame, col: str, n: int) -> tuple[int | None, int]:
    """(the n-th smallest value, how many of its equals belong to the first n); (None, 0) with fewer rows than n."""
    _, found = values_at(rows, col, [n - 1])
    if n - 1 not in found:
        return None, 0
    value, before = found[n - 1]
    return value, n - before
