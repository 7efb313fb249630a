"""Chronological grouped splits.

Cut points are linear-interpolated quantiles of the rows' creation instants;
a group goes to the latest split its newest row reaches, so no group crosses
splits.

Only groups that span a cut can move a row to a later split, so the wide rows
join just those groups -- broadcast when a count proves them few, which keeps
the text out of any shuffle (see ``assign_splits``).

The cut points come from exact order statistics (``order.py``): three counts,
no join, no sort of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import SPLIT_NAMES
from ticketlens.operators.order import values_at
from ticketlens.session import scratch_path

def check_fractions(validation_fraction: float, lockbox_fraction: float) -> None:
    if validation_fraction <= 0 or lockbox_fraction <= 0:
        raise ValueError("both split fractions have to be above 0")
    if validation_fraction + lockbox_fraction >= 0.5:
        raise ValueError("at least half of the rows have to stay in train")


def cut_fractions(validation_fraction: float, lockbox_fraction: float) -> dict[str, float]:
    # Evaluated in doubles in this order (1.0 - 0.2 - 0.1 != 0.7).
    return {
        "validation": 1.0 - validation_fraction - lockbox_fraction,
        "lockbox": 1.0 - lockbox_fraction,
    }


def cut_values(values: DataFrame, col: str, fractions: dict[str, float]) -> dict[str, int]:
    """Cut instants in microseconds, interpolated between two neighbours in float seconds; empty without rows."""

    def neighbours(n: int) -> dict[str, tuple[int, int, float]]:
        out = {}
        for name, f in fractions.items():
            at = (n - 1) * f
            low = int(at)
            out[name] = (low, min(low + 1, n - 1), at - low)
        return out

    n, found = values_at(values, col, ranks_of=lambda n: [r for lo, hi, _ in neighbours(n).values() for r in (lo, hi)] if n else [])
    if not n:
        return {}
    cuts = {}
    for name, (lo, hi, weight) in neighbours(n).items():
        seconds = found[lo][0] / 1e6 * (1.0 - weight) + found[hi][0] / 1e6 * weight
        whole = int(seconds)
        cuts[name] = whole * 1_000_000 + round((seconds - whole) * 1e6)  # half-even, like datetime.fromtimestamp
    return cuts


def split_cutoffs(values: DataFrame, col: str, fractions: dict[str, float]) -> DataFrame:  # G1
    """One row per cut: (name, cut_us)."""
    rows = sorted(cut_values(values, col, fractions).items())
    return values.sparkSession.createDataFrame(rows, "name string, cut_us long")


def group_latest(rows: DataFrame, group_col: str, ts_col: str) -> DataFrame:  # G2 / J4
    """Earliest and newest instant and row count per group (partial aggregation first)."""
    return rows.groupBy(group_col).agg(
        F.min(ts_col).alias("group_earliest_us"),
        F.max(ts_col).alias("group_latest_us"),
        F.count(F.lit(1)).alias("group_rows"),
    )


# Spanning groups are broadcast when a count shows at most this many
# (about 40 bytes each); beyond it the lookup is a shuffle join.
BROADCAST_GROUPS = 2_000_000
# In that shuffle join, a group with more rows than this is "hot": its rows are
# spread over SALTS partitions (the hot set holds at most rows / HOT_GROUP_ROWS
# groups, so it is broadcast with a proven bound).
HOT_GROUP_ROWS = 1_000_000
SALTS = 64


def _salted_left_join(rows: DataFrame, groups: DataFrame, group_col: str, row_key: str,
                      hot_group_rows: int, salts: int) -> DataFrame:
    """Left join on the group key; rows of every hot group, spanning or not, get a
    deterministic salt (hash of ``row_key``: a recomputed task gets the same one)
    and only hot spanning groups' single rows are replicated per salt."""
    hot = groups.where(F.col("group_rows") > hot_group_rows).select(group_col, F.lit(True).alias("_hot"))
    tagged = rows.join(F.broadcast(hot), group_col, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(row_key)), F.lit(salts))).otherwise(F.lit(0))
    salted_rows = tagged.withColumn("_salt", salt.cast("int")).drop("_hot")
    fan_out = F.when(F.col("group_rows") > hot_group_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    salted = groups.where("spans").select(group_col, "group_latest_us", F.explode(fan_out).alias("_salt"))
    return salted_rows.join(salted, [group_col, "_salt"], "left").drop("_salt")


def assign_splits(
    rows: DataFrame,
    validation_fraction: float,
    lockbox_fraction: float,
    ts_col: str = "created_us",
    group_col: str = "split_group_id",
    row_key: str = "sample_id",
    hot_group_rows: int = HOT_GROUP_ROWS,
    broadcast_groups: int = BROADCAST_GROUPS,
    salts: int = SALTS,
) -> DataFrame:  # G3
    """Add ``final_split``; cuts come from rows, membership from groups.

    A group's split is decided by its newest row. For a group whose rows all
    lie on the same side of each cut, every row's own instant already gives
    that split; only groups that *span* a cut can promote a row. So:

    1. the two cut values are located and used as literals;
    2. the spanning groups (usually few) and the hot ones are aggregated once,
       with partial aggregation, and written to the shared checkpoint folder;
    3. when a count proves them small they are broadcast and the wide rows
       are never shuffled; otherwise the rows take a shuffle join, salted for
       hot groups.
    """
    check_fractions(validation_fraction, lockbox_fraction)
    spark = rows.sparkSession
    fractions = cut_fractions(validation_fraction, lockbox_fraction)
    cuts = cut_values(rows, ts_col, fractions)
    if not cuts:
        raise ValueError("nothing to split: no labeled issue is left")
    v_cut, l_cut = cuts["validation"], cuts["lockbox"]

    groups = group_latest(rows, group_col, ts_col)
    early, late = F.col("group_earliest_us"), F.col("group_latest_us")
    spans = ((early < v_cut) & (late >= v_cut)) | ((early < l_cut) & (late >= l_cut))
    path = scratch_path(spark, "spanning-groups")
    kept = groups.withColumn("spans", spans).where(F.col("spans") | (F.col("group_rows") > hot_group_rows))
    kept.select(group_col, "group_latest_us", "group_rows", "spans").write.mode("errorifexists").parquet(path)
    known = spark.read.parquet(path)
    spanning = known.where("spans").select(group_col, "group_latest_us")

    if spanning.count() <= broadcast_groups:
        joined = rows.join(F.broadcast(spanning), group_col, "left")
    else:
        joined = _salted_left_join(rows, known, group_col, row_key, hot_group_rows, salts)
    latest = F.coalesce(F.col("group_latest_us"), F.col(ts_col))
    split = (
        F.when(latest >= F.lit(l_cut), F.lit(SPLIT_NAMES[2]))
        .when(latest >= F.lit(v_cut), F.lit(SPLIT_NAMES[1]))
        .otherwise(F.lit(SPLIT_NAMES[0]))
    )
    return joined.withColumn("group_latest_us", latest).withColumn("final_split", split)


def split_leakage(dataset: DataFrame, group_col: str = "split_group_id") -> DataFrame:  # G5
    """Groups found in more than one split (must be empty)."""
    return (
        dataset.groupBy(group_col)
        .agg(F.count_distinct("final_split").alias("n_splits"))
        .where(F.col("n_splits") > 1)
    )
