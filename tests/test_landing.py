"""issues landed by creation day; a window reads only its days and finds the same issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.operators import filters as FL
from ticketlens.sources import landing as LD

WINDOW = ("2024-02-10T01:00:00+02:00", "2024-02-12T22:00:00-03:00")  # 9 Feb 23:00 to 13 Feb 01:00 in UTC

ROWS = [
    (1, "2024-02-09T22:59:59Z", "2024-02-10T00:00:00Z"),  # just before
    (2, "2024-02-09T23:00:00Z", "2024-02-10T00:00:00Z"),
    (3, "2024-02-10T00:30:00+02:00", "2024-02-10T00:00:00Z"),  # the day before in UTC, too early
    (4, "2024-02-10T01:30:00+02:00", "2024-02-10T00:00:00Z"),
    (5, "2024-02-12T22:00:00-03:00", "2024-02-13T01:00:00Z"),  # the last instant, on the next day in UTC
    (6, "2024-02-13T01:00:01Z", "2024-02-13T01:00:00Z"),
    (7, "2024-02-11T00:00:00Z", None),
    (8, None, "2024-02-11T00:00:00Z"),
    (9, "2024-02-11T00:00:00", "2024-02-11T00:00:00Z"),  # names no instant
    (10, "2024-02-11T00:00:00Z", "2024-02-14T00:00:00Z"),  # closed too late
    (11, "2023-12-31T00:00:00Z", "2024-02-10T00:00:00Z"),
    (2, "2024-02-09T23:00:00Z", "2024-02-10T00:00:00Z"),  # a repeated row
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "number long, created_at string, closed_at string")


def numbers(df):
    return sorted(r["number"] for r in df.collect())


def test_same_issues_from_fewer_days(spark, tmp_path):
    path = LD.land_issues(frame(spark), str(tmp_path / "landed"))
    landed = LD.read_landed(spark, path)
    assert numbers(landed) == numbers(frame(spark))
    pruned = FL.filter_date_window(landed, *WINDOW)
    assert numbers(pruned) == numbers(FL.filter_date_window(frame(spark), *WINDOW)) == [2, 2, 4, 5]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "created_day" in filters and "2024-02-09" in filters and "2024-02-13" in filters


def test_streamed_window_and_no_rows(spark, tmp_path):
    path = LD.land_issues(frame(spark), str(tmp_path / "landed"))
    LD.land_issues(frame(spark, ROWS[:2]), path, mode="append")
    issues = LD.stream_landed(spark, path, LD.read_landed(spark, path).schema, max_files=2)
    query = FL.filter_date_window(issues, *WINDOW).select("number").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(str(tmp_path / "sink"))
    query.awaitTermination()
    assert numbers(spark.read.parquet(str(tmp_path / "sink"))) == [2, 2, 2, 4, 5]
    empty = FL.filter_date_window(frame(spark, []).withColumn(FL.CREATED_DAY, LD.creation_day(F.col("created_at"))), *WINDOW)
    assert empty.count() == 0
