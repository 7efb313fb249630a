"""Sharding (operator 6): contiguous shards of nearly equal bytes.

Rows are put in one global order (doc_id, then size and checksum, so that rows
that differ in nothing else are interchangeable). The order is cut into range
partitions, which are written once; each partition's byte and row totals give
its start offset (a running sum over one row per partition), a running sum
inside the partition gives every row its global byte offset, and the shard is
the equal share of the total in which the middle of the row falls. Only slim
rows (id, size, checksum) are shuffled, never the texts.

Cases: a null text has no bytes (size is the fixed overhead), checksum 0. A
null doc_id sorts first. Repeated rows are counted and placed one by one. An
empty table gives an empty table. A row larger than a share leaves shards
empty; it is never split. Extra columns are passed through, but a column named shard
or slot is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import written

OVERHEAD_BYTES = 8


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD_BYTES) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus the overhead) and the text's CRC-32."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )


def shard_by_bytes(rows: DataFrame, shards: int, order: tuple[str, ...] = ("doc_id", "size", "text_crc32")) -> DataFrame:
    """``rows`` (with a long column ``size``) plus ``shard`` and ``slot``.

    ``slot`` counts the rows of a shard from 0 without gaps, in the order.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = uuid.uuid4().hex[:8]  # working columns get names no column of the input has

    def own(name: str) -> str:
        return f"{name}_{tag}"

    part = own("part")
    ranged = written(
        spark, rows.repartitionByRange(parts, *keys).withColumn(part, F.spark_partition_id()), "shard-ranges"
    )
    totals = ranged.groupBy(part).agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # One row per range partition: the only single-task step, bounded by the partition count.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        part,
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias(own("byte_start")),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias(own("row_start")),
        F.sum("part_bytes").over(whole).alias(own("total")),
    )
    inside = Window.partitionBy(part).orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = f"((2 * ({own('byte_start')} + {own('in_bytes')}) - size) * {int(shards)}L) div (2 * {own('total')})"
    placed = (
        ranged.withColumn(own("in_bytes"), F.sum("size").over(running))
        .withColumn(own("in_rows"), F.row_number().over(inside))
        .join(F.broadcast(offsets), part)
        .withColumn(own("index"), F.col(own("row_start")) + F.col(own("in_rows")) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(middle).cast("int")))
    )
    # The first row of each shard: at most ``shards`` rows.
    firsts = placed.groupBy("shard").agg(F.min(own("index")).alias(own("first")))
    return (
        placed.join(F.broadcast(firsts), "shard")
        .withColumn("slot", (F.col(own("index")) - F.col(own("first"))).cast("long"))
        .select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")
    )
