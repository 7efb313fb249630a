"""Every registered query against its DuckDB oracle on the smallest tables.

The driver repeats this at sf0.01; here it runs at sf0.001 to stay quick.
The fitted TF-IDF model has no SQL; its scores are checked in test_baseline.py.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ticketlens import oracles, queries, verify

SF = "/root/testdata/sf0.001"
SLOW = {"tfidf_lr_scores", "score_batch_linear"}
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    return verify.duck_connection(SF)


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    assert set(NAMES) - set(oracles.oracle_sql()) == SLOW
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_query_matches_oracle(spark, duck, name):
    got = verify.run_spark(entry.queries()[name](spark, SF))
    want = verify.run_duck(duck, entry.oracle_sql()[name])
    res = verify.compare(got, want)
    assert res["schema_match"], (res["columns_spark"], res["columns_oracle"])
    assert res["rows_match"], (res["rows_spark"], res["rows_oracle"])
    assert res["hash_match"], verify.diff_rows(got, want, 3)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 44
    assert df.count() > 0
