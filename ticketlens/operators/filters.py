"""Row filters of the dataset build."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.parsing import unix_micros
from ticketlens.operators.order import nth_value
from ticketlens.sources.issues import valid_body

EPOCH = datetime.fromtimestamp(0, timezone.utc)
INVALID = "invalid:"
ACCEPTED = "accepted"
#: Partition column of issues landed by day (``sources.landing``).
CREATED_DAY = "created_day"


def instant_micros(value: str) -> int:
    """Zoned ISO-8601 parameter -> epoch microseconds; naive values are refused."""
    instant = datetime.fromisoformat(value)
    if instant.utcoffset() is None:
        raise ValueError(f"{value!r} names no time zone")
    return (instant - EPOCH) // timedelta(microseconds=1)


def filter_pull_requests(issues: DataFrame) -> DataFrame:  # F1
    """Drop pull requests (key presence, so a null or empty marker counts)."""
    return issues.where(~F.coalesce(F.col("is_pull_request"), F.lit(False)))


def filter_date_window(issues: DataFrame, created_after: str, closed_before: str) -> DataFrame:  # F2 + F3
    """String dates only; created in [created_after, closed_before], closed by closed_before.

    ``created <= closed_before`` is the early stop of a created-ascending scan.
    Comparisons are between instants (epoch microseconds), not strings, so
    mixed offsets compare correctly. Issues landed by day are first cut to the
    days of the window, which prunes the scan.
    """
    lo, hi = instant_micros(created_after), instant_micros(closed_before)
    created, closed = unix_micros(F.col("created_at")), unix_micros(F.col("closed_at"))
    if CREATED_DAY in issues.columns:
        first, last = ((EPOCH + timedelta(microseconds=us)).date() for us in (lo, hi))
        issues = issues.where(F.col(CREATED_DAY).between(F.lit(first), F.lit(last)))
    return issues.where(
        F.col("created_at").isNotNull()
        & F.col("closed_at").isNotNull()
        & (created >= F.lit(lo))
        & (created <= F.lit(hi))
        & (closed <= F.lit(hi))
    )


def filter_labeled(rows: DataFrame, labels_col: str = "retained") -> DataFrame:  # F4
    return rows.where(F.size(labels_col) > 0)


def first_n(rows: DataFrame, n: int, ts_col: str = "created_us", id_col: str = "number") -> DataFrame:  # F5 / O3
    """First ``n`` rows in scan order (creation time, then id).

    The n-th instant is located by distributed counts, so no task holds ``n``
    rows; only rows of exactly that instant are ranked by id.
    """
    cut, left = nth_value(rows, ts_col, n)
    if cut is None:  # fewer rows than n
        return rows
    ids = rows.where(F.col(ts_col) == cut).select(F.col(id_col).alias(ts_col))
    last, _ = nth_value(ids, ts_col, left)
    if last is None:
        last = ids.agg(F.max(ts_col).alias("m")).first()["m"]
    return rows.where((F.col(ts_col) < cut) | ((F.col(ts_col) == cut) & (F.col(id_col) <= last)))


def invalid_reason(issues: DataFrame) -> Column:  # F7
    """The first reason why no dataset row can be built from an issue, or NULL."""
    created, closed = F.col("created_at"), F.col("closed_at")
    return (
        F.when(F.col("number").isNull(), F.lit("number_not_int"))
        .when(F.col("title").isNull(), F.lit("title_not_string"))
        .when(~valid_body(issues), F.lit("body_not_string"))
        .when(created.isNull(), F.lit("created_at_not_string"))
        .when(unix_micros(created).isNull(), F.lit("created_at_not_zoned"))
        .when(closed.isNotNull() & unix_micros(closed).isNull(), F.lit("closed_at_not_zoned"))
    )


def invalid_issues(issues: DataFrame) -> DataFrame:  # F7
    """Quarantine: the issues no dataset row can be built from, with the first reason."""
    return issues.withColumn("reason", invalid_reason(issues)).where(F.col("reason").isNotNull())


def with_outcome(issues: DataFrame, created_after: str, closed_before: str, labels_col: str = "retained") -> DataFrame:
    """Adds ``created_us`` and ``outcome``: what the dataset build does with each scanned issue.

    Every issue has exactly one outcome: ``pull_request`` (F1), ``no_dates`` (F2),
    ``invalid:<reason>`` (F7: dates that do not parse, or an issue inside the
    window that is broken), ``outside_window`` (F3), ``unlabeled`` (F4) or
    ``accepted``. Nothing leaves the build without one.
    """
    lo, hi = instant_micros(created_after), instant_micros(closed_before)
    timed = issues.withColumns({
        "created_us": unix_micros(F.col("created_at")), "closed_us": unix_micros(F.col("closed_at")),
    })
    created, closed = F.col("created_us"), F.col("closed_us")
    outcome = (
        F.when(F.coalesce(F.col("is_pull_request"), F.lit(False)), F.lit("pull_request"))
        .when(F.col("created_at").isNull() | F.col("closed_at").isNull(), F.lit("no_dates"))
        .when(created.isNull(), F.lit(INVALID + "created_at_not_zoned"))
        .when(closed.isNull(), F.lit(INVALID + "closed_at_not_zoned"))
        .when((created < lo) | (created > hi) | (closed > hi), F.lit("outside_window"))
        .when(F.col("number").isNull(), F.lit(INVALID + "number_not_int"))
        .when(F.col("title").isNull(), F.lit(INVALID + "title_not_string"))
        .when(~valid_body(issues), F.lit(INVALID + "body_not_string"))
        .when(F.size(labels_col) == 0, F.lit("unlabeled"))
        .otherwise(F.lit(ACCEPTED))
    )
    return timed.withColumn("outcome", outcome).drop("closed_us")
