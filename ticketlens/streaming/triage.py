"""Streaming triage (ST1) and an idempotent label-application sink (ST2).

The stream runs the batch transforms unchanged: envelopes -> triage -> clean
-> score -> thresholds -> plan, with a stream-static join for the repository
label sets. The sink is a Parquet table with a checkpoint; ``availableNow``
drains what is landed and stops, so the same code serves scheduled runs.

Label application is a set union keyed by (owner, repo, issue_number,
label): each micro-batch anti-joins its partitions of the applied table before
appending, so a replayed batch (restart after failure, or a reprocessing run)
adds nothing and costs what the batch holds, not what was ever applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ticketlens.plans.triage import triage_issues
from ticketlens.sinks.labels import RunConfig, labels_to_write
from ticketlens.sources.catalog import LabelCatalog
from ticketlens.sources.events import stream_envelopes, stream_event_files

APPLIED_KEY = ["owner", "repo", "issue_number", "label"]


def land_envelopes(payloads: DataFrame, path: str) -> str:
    """Write (event_id, payload) as JSON-lines files, the streaming landing form (a file per task)."""
    payloads.select("event_id", "payload").write.mode("errorifexists").json(path)
    return path


def flatten_plan(plan: DataFrame) -> DataFrame:
    return plan.select(
        "event_id", "status", "reason", "owner", "repo", "issue_number", "model_input",
        F.array_join("labels_to_apply", "|").alias("labels_to_apply"),
        F.array_join("missing_labels", "|").alias("missing_labels"),
        "write_status", "exit_code", "model_version", "backend",
    )


def start_triage_stream(
    spark: SparkSession,
    landing: str,
    sink: str,
    checkpoint: str,
    catalog: LabelCatalog,
    config: RunConfig,
    repo_label_sets: DataFrame | None = None,
):
    events = stream_envelopes(spark, landing)
    plan = flatten_plan(triage_issues(events, catalog, config, repo_label_sets))
    return (
        plan.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


# The applied table is partitioned by a hash of the issue: a micro-batch reads
# and appends only the partitions its own issues fall into.
APPLIED_BUCKETS = 256


def _bucketed(labels: DataFrame) -> DataFrame:
    return labels.withColumn("bucket", F.pmod(F.xxhash64("owner", "repo", "issue_number"), F.lit(APPLIED_BUCKETS)).cast("int"))


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)  # nothing applied yet


def apply_batch(applied_path: str):
    """foreachBatch body: append only (owner, repo, issue_number, label) rows not applied yet."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        new = _bucketed(labels_to_write(batch).dropDuplicates(APPLIED_KEY)).persist()
        try:
            buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most APPLIED_BUCKETS
            done = _existing(batch.sparkSession, applied_path, new).where(F.col("bucket").isin(buckets))
            fresh = new.join(done.select(*APPLIED_KEY), APPLIED_KEY, "left_anti")
            # A bucket is written by one task (a busy one by a few), not by every task of the join.
            fresh.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(applied_path)
        finally:
            new.unpersist()

    return run


def start_apply_stream(
    spark: SparkSession,
    landing: str,
    applied_path: str,
    checkpoint: str,
    catalog: LabelCatalog,
    config: RunConfig,
    repo_label_sets: DataFrame | None = None,
):
    events = stream_envelopes(spark, landing)
    plan = triage_issues(events, catalog, config, repo_label_sets)
    return (
        plan.writeStream.foreachBatch(apply_batch(applied_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_file_triage_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, catalog: LabelCatalog, config: RunConfig):
    """Triage landed payload files, one JSON object each (S2 as a stream); the file path is the event's id."""
    events = stream_event_files(spark, landing).withColumnRenamed("event_path", "event_id")
    return (
        flatten_plan(triage_issues(events, catalog, config)).writeStream.format("parquet")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
