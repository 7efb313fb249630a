"""Issue-event sources (S2): landed webhook payload files, batch or stream.

A payload file holds one JSON object. ``wholetext`` makes each file one row,
so pretty-printed payloads work; the file path is the event's identity.
Envelope files (JSON lines of ``event_id, payload``) are the streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_SCHEMA = "event_id bigint, payload string"


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """(event_path, payload) per file; unreadable JSON is left to triage."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("event_path"), F.col("value").alias("payload")
    )


def stream_event_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
        .select(F.col("_metadata.file_path").alias("event_path"), F.col("value").alias("payload"))
    )


def stream_envelopes(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(ENVELOPE_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(path)
    )
