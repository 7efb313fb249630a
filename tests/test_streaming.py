"""Streaming triage equals batch triage; replaying the label stream adds nothing."""

from __future__ import annotations

from ticketlens.plans.triage import triage_issues
from ticketlens.queries import CATALOG, LIVE, repo_label_sets
from ticketlens.sources import testdata as td
from ticketlens.streaming import triage as ST

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_path):
    payloads = td.event_payloads(spark, SF)
    landing = ST.land_envelopes(payloads, str(tmp_path / "landing"))
    sets = repo_label_sets(spark, SF)

    sink = str(tmp_path / "sink")
    q = ST.start_triage_stream(spark, landing, sink, str(tmp_path / "ck1"), CATALOG, LIVE, sets)
    q.awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    batch = sorted(tuple(r) for r in ST.flatten_plan(triage_issues(payloads, CATALOG, LIVE, sets)).collect())
    assert streamed == batch

    applied = str(tmp_path / "applied")
    q = ST.start_apply_stream(spark, landing, applied, str(tmp_path / "ck2"), CATALOG, LIVE, sets)
    q.awaitTermination()
    first = sorted(tuple(r) for r in spark.read.parquet(applied).drop("bucket").collect())
    q = ST.start_apply_stream(spark, landing, applied, str(tmp_path / "ck3"), CATALOG, LIVE, sets)
    q.awaitTermination()
    again = sorted(tuple(r) for r in spark.read.parquet(applied).drop("bucket").collect())
    assert first == again and len(first) > 0
    assert len(set(first)) == len(first)


def test_a_broken_applied_table_is_not_taken_for_an_empty_one(spark, tmp_path):
    import pytest

    like = spark.createDataFrame([], "owner string, bucket int")
    assert ST._existing(spark, str(tmp_path / "none"), like).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ST._existing(spark, str(tmp_path / "broken"), like).collect()


def test_a_bucket_of_the_applied_table_is_one_file_of_a_batch(spark, tmp_path):
    """Every task of the join wrote a file into every bucket: files grew with tasks times buckets."""
    rows = [("apply", "o", f"r{i % 7}", i, ["kind/bug", "sig/node", "sig/storage"]) for i in range(4000)]
    plan = spark.createDataFrame(rows, "write_status string, owner string, repo string, issue_number long, labels_to_apply array<string>")
    ST.apply_batch(str(tmp_path / "applied"))(plan, 0)
    ST.apply_batch(str(tmp_path / "applied"))(plan, 1)
    buckets = [p for p in (tmp_path / "applied").iterdir() if p.is_dir()]
    assert len(buckets) > 200 and all(len(list(p.glob("*.parquet"))) == 1 for p in buckets)
    assert spark.read.parquet(str(tmp_path / "applied")).drop("bucket").distinct().count() == 12_000
