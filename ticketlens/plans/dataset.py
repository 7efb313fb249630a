"""Training-set build (P1-P3): issues in, cleaned multi-label rows with splits out.

Plan shape: scan -> one outcome per issue -> one narrow projection (cleaning,
labels, targets) written once -> three small counts for the cut points, one
aggregate of the split groups -> broadcast lookup of the groups that span a
cut. Issues that cannot become rows are quarantined with a reason, or end the
job in strict mode; none disappears.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import DEFAULT_REPOSITORY
from ticketlens.functions import labels as L
from ticketlens.functions import text as T
from ticketlens.functions.parsing import issue_url, sample_id, unix_micros
from ticketlens.operators import filters, splits
from ticketlens.session import scratch_path

BASE_COLUMNS = (
    "sample_id",
    "issue_number",
    "issue_url",
    "issue_created_at",
    "cleaned_issue_title",
    "cleaned_issue_body",
    "model_input",
    "kind_labels",
    "sig_labels",
    "area_labels",
    "retained_labels",
    "retained_label_count",
    "split_group_id",
)


def dataset_columns(labels: Sequence[str]) -> list[str]:
    return [*BASE_COLUMNS, *L.target_columns(labels), "final_split"]


def with_retained(issues: DataFrame, labels: Sequence[str]) -> DataFrame:  # A1
    return issues.withColumn("retained", L.retained_labels(F.col("labels"), labels))


def cleaned_issues(issues: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Adds clean title and body (one pass over both), the title's grouping key and the split group id."""
    cleaned = T.clean_columns(issues, {"clean_title": F.col("title"), "clean_body": F.col("body")}, labels)
    keyed = T.add_title_key(cleaned, "clean_title", "title_key")
    return keyed.withColumn("split_group_id", T.split_group_id(F.col("title_key"), F.col("number")))


def build_rows(issues: DataFrame, labels: Sequence[str], repository: str = DEFAULT_REPOSITORY) -> DataFrame:  # P1
    """One dataset row per issue (expects ``retained``); keeps ``created_us`` for splits."""
    labels = list(labels)
    base = issues.select("number", "created_at", "html_url", "retained", "title", "body")
    cleaned = cleaned_issues(base, labels)
    retained = F.col("retained")
    return cleaned.select(
        sample_id(F.col("number")).alias("sample_id"),
        F.col("number").alias("issue_number"),
        issue_url(F.col("html_url"), F.col("number"), repository).alias("issue_url"),
        F.col("created_at").alias("issue_created_at"),
        F.col("clean_title").alias("cleaned_issue_title"),
        F.col("clean_body").alias("cleaned_issue_body"),
        T.model_input(F.col("clean_title"), F.col("clean_body")).alias("model_input"),
        L.labels_with_prefix(retained, "kind/").alias("kind_labels"),
        L.labels_with_prefix(retained, "sig/").alias("sig_labels"),
        L.labels_with_prefix(retained, "area/").alias("area_labels"),
        F.array_join(retained, "|").alias("retained_labels"),
        F.size(retained).alias("retained_label_count"),
        "split_group_id",
        *L.multi_hot(retained, labels),
        unix_micros(F.col("created_at")).alias("created_us"),
    )


def collect_rows(
    issues: DataFrame,
    labels: Sequence[str],
    repository: str = DEFAULT_REPOSITORY,
    max_issues: int | None = None,
    ordered: bool = False,
) -> DataFrame:  # P2 = F4 -> P1 -> F5 -> O1
    kept = filters.filter_labeled(with_retained(issues, labels))
    if max_issues is not None:
        kept = filters.first_n(kept.withColumn("created_us", unix_micros(F.col("created_at"))), max_issues)
    rows = build_rows(kept, labels, repository)
    return order_dataset(rows) if ordered else rows


def order_dataset(rows: DataFrame) -> DataFrame:  # O1
    """Creation time *string*, then number (the published file order)."""
    return rows.orderBy("issue_created_at", "issue_number")


@dataclass(frozen=True)
class Build:
    """A dataset build: its rows with splits, the quarantined issues, and the count of issues per outcome."""

    rows: DataFrame
    quarantine: DataFrame
    outcomes: DataFrame


def _checked(tagged: DataFrame) -> DataFrame:
    """Strict mode: an invalid issue ends the job, naming itself."""
    message = F.concat(
        F.lit("issue "), F.coalesce(F.col("number").cast("string"), F.lit("without a number")), F.lit(" is "), F.col("outcome")
    )
    bad = F.col("outcome").startswith(filters.INVALID)
    return tagged.withColumn("outcome", F.when(bad, F.raise_error(message)).otherwise(F.col("outcome")))


def build(
    issues: DataFrame,
    labels: Sequence[str],
    created_after: str,
    closed_before: str,
    validation_fraction: float = 0.15,
    lockbox_fraction: float = 0.10,
    repository: str = DEFAULT_REPOSITORY,
    max_issues: int | None = None,
    strict: bool = False,
) -> Build:  # P3
    """Filters, quarantine, cleaned rows and splits over scanned issues.

    The cleaned rows are written once to the shared folder; cut points, groups
    and the result all read that table, so the cleaning runs once per row.
    """
    splits.check_fractions(validation_fraction, lockbox_fraction)
    tagged = filters.with_outcome(with_retained(issues, labels), created_after, closed_before)
    if strict:
        tagged = _checked(tagged)
    accepted = tagged.where(F.col("outcome") == filters.ACCEPTED)
    if max_issues is not None:
        accepted = filters.first_n(accepted, max_issues)
    rows = build_rows(accepted, labels, repository)
    path = scratch_path(issues.sparkSession, "dataset-rows")
    rows.write.mode("errorifexists").parquet(path)
    cleaned = issues.sparkSession.read.schema(rows.schema).parquet(path)
    assigned = splits.assign_splits(cleaned, validation_fraction, lockbox_fraction)
    quarantine = tagged.where(F.col("outcome").startswith(filters.INVALID))
    return Build(
        assigned.select(*dataset_columns(labels)),
        quarantine.withColumn("reason", F.substring_index("outcome", ":", -1)).drop("outcome", "retained", "created_us"),
        tagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("issues")),
    )


def build_dataset(
    issues: DataFrame,
    labels: Sequence[str],
    created_after: str,
    closed_before: str,
    validation_fraction: float = 0.15,
    lockbox_fraction: float = 0.10,
    repository: str = DEFAULT_REPOSITORY,
    max_issues: int | None = None,
    ordered: bool = False,
    strict: bool = False,
) -> DataFrame:  # P3, the rows only
    out = build(issues, labels, created_after, closed_before, validation_fraction, lockbox_fraction,
                repository, max_issues, strict).rows
    return order_dataset(out) if ordered else out
