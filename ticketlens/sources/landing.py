"""Issues landed by day of creation (S1, F3): a date window reads only its days.

The day is that of the creation instant in UTC, so any window of instants lies
within a range of days; ``filter_date_window`` adds that range as a predicate on
the partition column and the scan lists no other folder. Issues without a
creation instant land in the null partition, which no window reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.parsing import unix_micros
from ticketlens.operators.filters import CREATED_DAY


def creation_day(created_at: Column) -> Column:
    """UTC day of a zoned ISO-8601 text, NULL if it names no instant."""
    return F.to_date(F.timestamp_micros(unix_micros(created_at)))


def land_issues(issues: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write issues partitioned by creation day; a busy day is spread over several tasks and files."""
    dayed = issues.withColumn(CREATED_DAY, creation_day(F.col("created_at")))
    dayed.hint("rebalance", CREATED_DAY).write.mode(mode).partitionBy(CREATED_DAY).parquet(path)
    return path


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """The landed issues with their day, a real date whatever the folder names look like."""
    found = spark.read.parquet(path)
    return found.withColumn(CREATED_DAY, F.col(CREATED_DAY).cast("date")) if dict(found.dtypes)[CREATED_DAY] != "date" else found


def stream_landed(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """The same folder as a stream of issues: every landed file once, in micro-batches of at most ``max_files``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
