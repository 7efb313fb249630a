"""Full triage (P4): payloads -> triage -> clean -> score -> thresholds -> plan.

All narrow except the optional repository check (one join on the
repository). The same function serves batch and streaming inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import text as T
from ticketlens.operators import postprocess as PP
from ticketlens.operators import scoring as S
from ticketlens.operators.triage import ACCEPTED, triage_events
from ticketlens.sinks.labels import RunConfig, label_write_plan
from ticketlens.sources.catalog import LabelCatalog


def score_events(triaged: DataFrame, catalog: LabelCatalog) -> DataFrame:
    """Model input, keyword scores, post-processing and chosen labels per event."""
    ok = F.col("status") == ACCEPTED
    labels = list(catalog.labels)
    cleaned = T.clean_columns(
        triaged, {"clean_title": F.when(ok, F.col("title")), "clean_body": F.when(ok, F.col("body"))}, labels
    )
    scored = cleaned.withColumn("model_input", F.when(ok, T.model_input(F.col("clean_title"), F.col("clean_body"))))
    scored = S.with_keyword_scores(scored, "model_input", catalog)
    scored = scored.withColumn("predictions", F.when(ok, F.col("predictions")))
    scored = scored.withColumn("postprocessed", PP.postprocess_aligned(F.col("predictions"), catalog))
    scored = scored.withColumn(
        "labels_to_apply", F.coalesce(PP.selected_labels(F.col("postprocessed")), F.array().cast("array<string>"))
    )
    return S.stamp(scored.drop("clean_title", "clean_body"), catalog, "development")


def triage_issues(
    payloads: DataFrame,
    catalog: LabelCatalog,
    config: RunConfig = RunConfig(),
    repo_label_sets: DataFrame | None = None,
    payload_col: str = "payload",
) -> DataFrame:  # P4
    scored = score_events(triage_events(payloads, payload_col), catalog)
    if config.needs_repo_labels:
        if repo_label_sets is None:
            raise ValueError("live label writes need the repository label sets")
        scored = PP.missing_repo_labels(scored, repo_label_sets, catalog)
    return label_write_plan(scored, config)
