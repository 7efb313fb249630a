"""Tokens (A5-A7), post-processing (I4, J1, A8), scorers (I1-I3), label plan (K4-K6)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import tokens as TK
from ticketlens.operators import postprocess as PP
from ticketlens.operators import scoring as S
from ticketlens.sinks.labels import RunConfig, label_write_plan
from ticketlens.sources.catalog import LabelCatalog


def test_head_tail_keeps_head_and_tail(spark):
    df = spark.createDataFrame([(list(range(20)),), (list(range(5)),)], "t array<int>")
    out = df.select(TK.with_specials(TK.head_tail(F.col("t"), 8, 2), 101, 102).alias("ids")).collect()
    assert out[0]["ids"] == [101, 0, 1, 2, 3, 18, 19, 102]
    assert out[1]["ids"] == [101, 0, 1, 2, 3, 4, 102]


def test_head_tail_rejects_short_budgets():
    with pytest.raises(ValueError):
        TK.head_tail_sizes(7, 2)


def test_pad_batches(spark):
    df = spark.createDataFrame([(1, 0, [1] * 3), (2, 0, [1] * 9), (3, 1, [1] * 8)], "id int, b int, ids array<int>")
    got = {r["id"]: (r["padded_length"], r["n_pad"], sum(r["attention_mask"]))
           for r in TK.pad_batches(df, "b", "ids", 0).collect()}
    assert got == {1: (16, 13, 3), 2: (16, 7, 9), 3: (8, 0, 8)}


def _preds(spark, rows):
    return spark.createDataFrame(
        [(rows,)], "predictions array<struct<label:string,taxonomy:string,score:double>>")


def test_thresholds_and_catalog_order(spark):
    cat = LabelCatalog.with_thresholds(["kind/bug", "sig/node"], {"kind/bug": 0.5, "sig/node": 0.7})
    df = _preds(spark, [("sig/node", "sig", 0.8), ("kind/bug", "kind", 0.4)])
    post = df.select(PP.postprocess_array(F.col("predictions"), cat).alias("p")).first()["p"]
    assert [p["label"] for p in post] == ["kind/bug", "sig/node"]
    assert [p["selected"] for p in post] == [False, True]
    chosen = df.select(PP.selected_labels(PP.postprocess_array(F.col("predictions"), cat)).alias("l")).first()["l"]
    assert chosen == ["sig/node"]


def test_unknown_and_mismatched_predictions_are_dropped(spark):
    cat = LabelCatalog.with_thresholds(["kind/bug"], {"kind/bug": 0.5})
    df = _preds(spark, [("kind/bug", "sig", 0.9), ("sig/unknown", "sig", 0.9)])
    post = df.select(PP.postprocess_array(F.col("predictions"), cat).alias("p")).first()["p"]
    assert post == []
    long = spark.createDataFrame([(1, "kind/bug", "sig", 0.9), (1, "sig/unknown", "sig", 0.9)],
                                 "id int, label string, taxonomy string, score double")
    reasons = sorted(r["reason"] for r in PP.rejected_predictions(long, cat, spark).collect())
    assert reasons == ["taxonomy_mismatch", "unknown_label"]
    assert PP.postprocess_long(long, cat, spark).count() == 0


def test_duplicate_selected_labels_removed(spark):
    cat = LabelCatalog.with_thresholds(["kind/bug", "sig/node"], {"kind/bug": 0.5, "sig/node": 0.5})
    df = _preds(spark, [("kind/bug", "kind", 0.9), ("kind/bug", "kind", 0.9), ("sig/node", "sig", 0.8)])
    chosen = df.select(PP.selected_labels(PP.postprocess_array(F.col("predictions"), cat)).alias("l")).first()["l"]
    assert chosen == ["kind/bug", "sig/node"]


def test_keyword_scores_are_deterministic_substrings(spark, catalog):
    df = spark.createDataFrame([("Title: sig-auth: token request failing on kubectl scheduler\nBody: nodes",)], "t string")
    row = df.select(S.keyword_scores(F.col("t"), catalog).alias("p")).first()["p"]
    scores = {p["label"]: p["score"] for p in row}
    assert len(scores) == len(catalog.labels)
    for label in ("sig/cli", "area/kubectl", "sig/auth", "sig/scheduling", "sig/node"):
        assert scores[label] == 0.9
    assert scores["kind/bug"] == 0.1 and scores["sig/windows"] == 0.1


def test_one_event_from_payload_to_report(spark, catalog):
    import json

    from ticketlens.plans.triage import triage_issues
    from ticketlens.sinks.labels import dry_run_report

    issue = {"number": 88, "title": "Kubectl hangs", "body": None, "html_url": "https://tracker.test/88", "user": {"type": "User", "login": "ann"}}
    event = {"action": "reopened", "issue": issue, "repository": {"name": "tool", "owner": {"login": "acme"}}}
    df = spark.createDataFrame([(1, json.dumps(event))], "event_id long, payload string")
    plan = triage_issues(df, catalog, RunConfig(dry_run=True))
    row = plan.first()
    assert (row["write_status"], row["exit_code"], row["owner"], row["issue_number"]) == ("dry_run", 0, "acme", 88)
    assert row["model_input"] == "Title: Kubectl hangs\nBody:" and row["model_version"] == "1.0.0 (non-production)"
    report = dry_run_report(plan).collect()
    assert {r["label"] for r in report} == set(row["labels_to_apply"]) >= {"area/kubectl", "sig/cli"}
    assert {r["score"] for r in report} == {0.9}


def test_repository_check_in_all_join_forms(spark, catalog):
    known = list(catalog.labels[:3])
    plans = spark.createDataFrame(
        [(i, f"t{i}", "o", "hot" if i % 4 else f"r{i}", known) for i in range(40)],
        "issue_number long, title string, owner string, repo string, labels_to_apply array<string>")
    sets = spark.createDataFrame([("o", "hot", known[:1] + ["x"]), ("o", "r0", known)], "owner string, repo string, labels array<string>")

    def missing(**bounds):
        return {r["issue_number"]: tuple(r["missing_labels"]) for r in PP.missing_repo_labels(plans, sets, catalog, **bounds).collect()}

    small = missing()
    assert small == missing(broadcast_labels=0) == missing(broadcast_labels=0, hot_rows=5, salts=4)
    assert small[0] == () and small[4] == tuple(known) and small[1] == tuple(known[1:]) and len(small) == 40


def test_batch_scorer_matches_expression_scorer(spark, catalog):
    df = spark.createDataFrame([(1, "kubelet bug"), (2, "Cloud provider CERT"), (3, None)], "id long, t string")
    a = {(r["id"], r["label"]): r["score"] for r in S.explode_predictions(
        df.select("id", S.keyword_scores(F.coalesce("t", F.lit("")), catalog).alias("predictions")), ["id"]).collect()}
    scored = S.score_batch(df, "t", ["id"], catalog, S.create_scorer("development", catalog))
    b = {(r["id"], r["label"]): r["score"] for r in S.explode_predictions(scored, ["id"]).collect()}
    assert a == b
    with pytest.raises(ValueError):
        S.create_scorer("nope", catalog)


def test_logit_width_is_checked(spark, catalog):
    df = spark.createDataFrame([([0.0, 1.0],)], "x array<double>")
    with pytest.raises(Exception):
        df.select(S.logit_scores(F.col("x"), catalog)).collect()


PLAN_ROWS = [(1, "accepted", "o", "r", ["kind/bug"], ["kind/bug"]),
             (2, "accepted", "o", "r", [], []),
             (3, "ignored", None, None, [], []),
             (4, "malformed", None, None, [], []),
             (5, "accepted", "o", "r", ["kind/bug", "sig/node"], ["kind/bug"]),
             (6, "accepted", None, None, ["kind/bug"], [])]


@pytest.mark.parametrize("config, expected", [
    (RunConfig(dry_run=False, apply_labels=True, backend="development"), ["blocked_dev"] * 6),
    (RunConfig(dry_run=False, apply_labels=False, backend="transformer"), ["disabled"] * 6),
    (RunConfig(dry_run=True), ["dry_run", "dry_run", "ignored", "malformed", "dry_run", "dry_run"]),
    (RunConfig(dry_run=False, apply_labels=True, backend="transformer"),
     ["apply", "no_labels", "ignored", "malformed", "missing_labels", "no_event"]),
])
def test_write_status_ladder(spark, config, expected):
    df = spark.createDataFrame(
        [(i, st, o, r, labels, repo) for i, st, o, r, labels, repo in PLAN_ROWS],
        "event_id long, status string, owner string, repo string, labels_to_apply array<string>, repo_labels array<string>")
    df = df.withColumn("missing_labels", F.array_except("labels_to_apply", "repo_labels"))
    got = [r["write_status"] for r in label_write_plan(df, config).orderBy("event_id").collect()]
    assert got == expected


def test_aligned_postprocess_equals_general_form(spark, catalog):
    df = spark.createDataFrame([("kubelet bug in kubectl",), ("nothing here",), ("",)], "t string")
    scored = df.select(S.keyword_scores(F.col("t"), catalog).alias("p"))
    rows = scored.select(PP.postprocess_array(F.col("p"), catalog).alias("a"),
                         PP.postprocess_aligned(F.col("p"), catalog).alias("b")).collect()
    for r in rows:
        assert r["a"] == r["b"]


def test_scorer_closure_unpickles_without_the_package(catalog, tmp_path):
    """Executors may not have this package importable: scorer closures carry plain data."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "scorer.pkl").write_bytes(cloudpickle.dumps(S.create_scorer("development", catalog)))
    code = ("import pickle, sys, pandas as pd; f = pickle.load(open(sys.argv[1], 'rb')); "
            "print(f(pd.Series(['kubelet bug', None])).shape)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", code, str(tmp_path / "scorer.pkl")], cwd=tmp_path,
                         capture_output=True, text=True, env=env, timeout=120)
    assert res.returncode == 0, res.stderr[-2000:]
    assert res.stdout.strip() == f"(2, {len(catalog.labels)})"
