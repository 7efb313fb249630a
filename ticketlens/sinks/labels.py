"""Label application plan (K4, K5) and dry-run report (K6).

The single-event exit codes of a command-line run become per-row columns:
``write_status`` says what would happen to each event and ``exit_code`` what a
single-event run would have returned. One bad event never stops the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import DRY_RUN_SCORE_DIGITS
from ticketlens.functions.arrays import explode_computed

# write_status -> exit code of a single-event run
EXIT_CODES = {
    "blocked_dev": 1,
    "disabled": 0,
    "ignored": 0,
    "malformed": 1,
    "dry_run": 0,
    "no_labels": 0,
    "no_event": 1,
    "missing_labels": 1,
    "apply": 0,
}


@dataclass(frozen=True)
class RunConfig:
    dry_run: bool = True
    apply_labels: bool = False
    allow_development_writes: bool = False
    backend: str = "development"

    @property
    def needs_repo_labels(self) -> bool:
        return not self.dry_run and self.apply_labels and not self._blocked

    @property
    def _blocked(self) -> bool:
        return not self.dry_run and self.backend == "development" and not self.allow_development_writes


def write_status(config: RunConfig) -> Column:  # K5 gates first, then per event
    """Status ladder; run-level gates are decided on the driver, the rest per row."""
    if config._blocked:
        return F.lit("blocked_dev")
    if not config.dry_run and not config.apply_labels:
        return F.lit("disabled")
    per_event = F.when(F.col("status") == "ignored", F.lit("ignored")).when(F.col("status") == "malformed", F.lit("malformed"))
    if config.dry_run:
        return per_event.otherwise(F.lit("dry_run"))
    return (
        per_event.when(F.size("labels_to_apply") == 0, F.lit("no_labels"))
        .when(F.col("owner").isNull(), F.lit("no_event"))  # a bare title and body: nowhere to write
        .when(F.size("missing_labels") > 0, F.lit("missing_labels"))
        .otherwise(F.lit("apply"))
    )


def exit_code(status: Column) -> Column:
    expr = None
    for name, code in EXIT_CODES.items():
        expr = F.when(status == name, F.lit(code)) if expr is None else expr.when(status == name, F.lit(code))
    return expr


def label_write_plan(triaged: DataFrame, config: RunConfig) -> DataFrame:  # K4
    """Adds write_status and exit_code (expects labels_to_apply, and
    missing_labels when the config needs the repository check)."""
    df = triaged
    if "missing_labels" not in df.columns:
        df = df.withColumn("missing_labels", F.array().cast("array<string>"))
    status = write_status(config)
    return df.withColumn("write_status", status).withColumn("exit_code", exit_code(F.col("write_status")))


def labels_to_write(plan: DataFrame) -> DataFrame:
    """(owner, repo, issue_number, label) rows the plan would add."""
    applying = plan.where(F.col("write_status") == "apply")
    return explode_computed(applying, ["owner", "repo", "issue_number"], F.col("labels_to_apply"), "label")


def dry_run_report(triaged: DataFrame, id_col: str = "event_id") -> DataFrame:  # K6
    """Chosen labels with the score rounded to 4 places and the threshold."""
    chosen = explode_computed(triaged, [id_col], F.filter("postprocessed", lambda p: p["selected"]), "p")
    return chosen.select(
        id_col,
        F.col("p.label").alias("label"),
        F.round(F.col("p.score"), DRY_RUN_SCORE_DIGITS).alias("score"),
        F.col("p.threshold").alias("threshold"),
    )
