"""The sweep over every distinct score against a brute-force count (E4, exact)."""

from __future__ import annotations

import random

import pytest

from ticketlens.operators import evaluate as E

SCHEMA = "taxonomy string, score double, is_true int"


def brute(rows):
    out = []
    for taxonomy in {t for t, _, _ in rows}:
        mine = [(s, y) for t, s, y in rows if t == taxonomy]
        scored = [(s, y) for s, y in mine if s is not None and s == s]
        for threshold in {s for s, _ in scored}:
            tp = sum(y for s, y in scored if s >= threshold)
            fp = sum(1 - y for s, y in scored if s >= threshold)
            fn = sum(y for _, y in mine) - tp
            out.append((taxonomy, threshold, tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0))
    return out


def got(spark, rows):
    sweep = E.exact_sweep(spark.createDataFrame(rows, SCHEMA))
    return sorted(sweep.select("taxonomy", "threshold", "tp", "fp", "fn", "f1").collect(), key=repr), sweep


def test_every_distinct_score_is_a_threshold(spark):
    rnd = random.Random(3)
    # One taxonomy holds most rows and is cut over several ranges; scores tie.
    rows = [("kind" if rnd.random() < 0.8 else "sig", rnd.randint(0, 900) / 300 - 1, int(rnd.random() < 0.3)) for _ in range(6000)]
    found, sweep = got(spark, rows)
    assert sorted(map(tuple, found)) == sorted(brute(rows))
    want = {}
    for taxonomy, threshold, *_, f1 in brute(rows):
        want[taxonomy] = max(want.get(taxonomy, (-1.0, 0.0)), (f1, -threshold))
    best = {r["taxonomy"]: (r["f1"], -r["threshold"]) for r in E.best_exact(sweep).collect()}
    assert best == want


def test_missing_scores_are_missed_at_every_threshold(spark):
    rows = [("kind", 0.5, 1), ("kind", None, 1), ("kind", float("nan"), 1), ("kind", None, 0), ("kind", 0.0, 0), ("kind", -0.0, 1)]
    found, _ = got(spark, rows)
    assert sorted((r["threshold"], r["tp"], r["fp"], r["fn"]) for r in found) == [(0.0, 2, 1, 2), (0.5, 1, 0, 3)]


@pytest.mark.parametrize("rows", [[], [("sig", None, 1)], [(None, 0.25, 1), (None, 0.75, 0)]])
def test_empty_unscored_and_nameless(spark, rows):
    found, _ = got(spark, rows)
    assert [(r["threshold"], r["tp"], r["fp"]) for r in found] == ([(0.25, 1, 1), (0.75, 0, 1)] if len(rows) == 2 else [])
