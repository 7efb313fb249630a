"""Plan shape: the properties that matter at scale, checked on the physical plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = entry.queries()
    names = ["build_dataset", "triage_issues", "score_keywords", "dry_run_report", "threshold_sweep", "eval_micro"]
    return {n: plan_text(qs[n](spark, SF)) for n in names}


def test_no_cartesian_products(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text, name


def test_cut_points_are_literals_and_rows_are_not_shuffled(plans):
    text = plans["build_dataset"]
    assert not re.findall(r"scalar-subquery#(\d+)", text)
    assert "SortMergeJoin" not in text  # spanning groups are broadcast


def test_cleaning_runs_once_per_field(plans):
    # one NFKC and one markdown pass for title+body, one NFKC pass for the title
    # key; explode must not re-evaluate the cleaned text through an inferred filter
    assert plans["score_keywords"].count("ArrowEvalPython") <= 3
    assert plans["dry_run_report"].count("ArrowEvalPython") <= 2
    assert plans["build_dataset"].count("ArrowEvalPython") == 0  # reads the cleaned rows it wrote


def test_threshold_sweep_has_no_nested_loop_join(plans):
    assert "NestedLoopJoin" not in plans["threshold_sweep"]
    assert "NestedLoopJoin" not in plans["eval_micro"]


def test_scans_read_only_needed_columns(plans):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans["triage_issues"]):
        assert "value" not in schema and "props" not in schema
