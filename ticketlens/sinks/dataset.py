"""Dataset writer (K1), split manifest (K2) and content digests (K3).

The writer partitions by ``final_split`` (each task writes its own part files
per split, no extra exchange) and refuses an existing target. Parquet is the
primary format; CSV is available with RFC-4180 quoting (bodies hold newlines
and quotes) and must be read back with ``multiLine``.

Deliberate change: a split is many part files, not one byte stream, so its
digest is computed over row contents and is independent of order and file
layout: per row SHA-256 over the values, folded with XOR and with a wide sum
(both order-free, both partial aggregates).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.fixed_values import DEFAULT_REPOSITORY, SPLIT_METHOD, SPLIT_NAMES

ROW_SEPARATOR = "\u001f"


def write_dataset(dataset: DataFrame, path: str, fmt: str = "parquet") -> str:
    # The partition column leads, so the writer keeps the order inside every file.
    ordered = dataset.sortWithinPartitions("final_split", "issue_created_at", "issue_number")
    writer = ordered.write.mode("errorifexists")
    writer = writer.partitionBy("final_split")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)
    else:
        raise ValueError(f"unsupported dataset format {fmt!r}")
    return path


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def row_hash(columns: list[str]) -> Column:
    """60-bit integer from the SHA-256 of the row's values (in column order)."""
    # A value is marked, so NULL and the empty string differ.
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    text = F.concat_ws(ROW_SEPARATOR, *marked)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def split_digest(dataset: DataFrame, columns: list[str]) -> DataFrame:  # K3
    h = row_hash(columns)
    return dataset.groupBy("final_split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    )


def split_manifest(
    dataset: DataFrame,
    columns: list[str],
    labels: Sequence[str],
    created_after: str,
    closed_before: str,
    validation_fraction: float,
    lockbox_fraction: float,
    repository: str = DEFAULT_REPOSITORY,
) -> DataFrame:  # K2 + K3 + G4
    """One row per split (empty ones too): the run's parameters, rows, distinct groups and content digest."""
    names = dataset.sparkSession.createDataFrame([(n,) for n in SPLIT_NAMES], "final_split string")
    digest = split_digest(dataset, columns)
    groups = dataset.groupBy("final_split").agg(F.count_distinct("split_group_id").alias("groups"))
    per_split = names.join(digest, "final_split", "left").join(groups, "final_split", "left")

    def utc(value: str) -> str:
        return datetime.fromisoformat(value).astimezone(timezone.utc).isoformat()

    run = {
        "repository": repository, "created_after": utc(created_after), "closed_before": utc(closed_before),
        "split_method": SPLIT_METHOD, "validation_fraction": float(validation_fraction),
        "lockbox_fraction": float(lockbox_fraction), "labels": "|".join(labels),
    }
    rows = F.coalesce("rows", F.lit(0))
    return per_split.select(
        "final_split", rows.alias("rows"), F.coalesce("groups", F.lit(0)).alias("groups"),
        F.coalesce("xor_hash", F.lit(0).cast("bigint")).alias("xor_hash"), F.coalesce("sum_hash", F.lit("0")).alias("sum_hash"),
        F.sum(rows).over(Window.partitionBy()).alias("total_rows"),  # three rows
        *[F.lit(v).alias(k) for k, v in run.items()],
    )
