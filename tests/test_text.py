"""Text contract: golden cases, step equivalences and stack safety."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlens.functions import text as T

LABELS_A = ["kind/bug", "sig/node"]
LABELS_B = ["kind/bug", "kind/cleanup", "kind/feature", "sig/node", "area/test"]


def prepare(spark, rows, labels):
    """Model input for (title, body) rows through the plan form (one projection per step)."""
    df = spark.createDataFrame(rows, "title string, body string")
    out = T.clean_columns(df, {"ct": F.col("title"), "cb": F.col("body")}, labels)
    return [r[0] for r in out.select(T.model_input(F.col("ct"), F.col("cb"))).collect()]


def clean_both_ways(spark, texts, labels):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stepped = T.clean_columns(df, {"g": F.col("t")}, labels)
    rows = stepped.select("t", "g", T.clean_field(F.col("t"), labels).alias("u")).collect()
    return rows


def test_title_and_body_become_one_input(spark):
    got = prepare(spark, [("Scheduler stalls", "Log at http://logs.test/run?id=9\n/area scheduling")], LABELS_A)
    assert got == ["Title: Scheduler stalls\nBody: Log at <URL>"]


@pytest.mark.parametrize("line", [
    "/hold", "> /lgtm", "  >> /close", "* /assign @me", "+ [X] /retest", "12) /sig node", "7. [ ] /kind bug", "```/joke", "` /woof` trailing",
])
def test_command_lines_leave_nothing(spark, line):
    assert prepare(spark, [("t", f"before\n{line}\nafter")], LABELS_B) == ["Title: t\nBody: before\nafter"]


def test_commands_inside_a_sentence(spark):
    body = "Run `/lgtm cancel` or ``/area test`` but not /lgtm nor `/unheard of`."
    assert prepare(spark, [("t", body)], []) == ["Title: t\nBody: Run or but not /lgtm nor `/unheard of`."]


def test_empty_and_null_body_leave_bare_body_marker(spark):
    got = prepare(spark, [("x", None), ("x", ""), ("", "  \n\t ")], [])
    assert got == ["Title: x\nBody:", "Title: x\nBody:", "Title: \nBody:"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("\ufb01le \uff21\uff22\uff23\uff11\uff12\uff13", "file ABC123"),  # ligature, full-width
        ("a\u00a0b", "a b"),  # no-break space is a space after NFKC
        ("![  shot  ](u.png) and [ log ](https://x.test/a(b)c)", "shot and log"),
        ("<!-- hidden\nline -->kept<br/>next", "kept\nnext"),
        ("Fixes #12 and a#3 and #4b", "Fixes <ISSUE_REF> and a#3 and #4b"),
        ("about  sig/node  and  kind_bug  and sig%2Fnode and @kubernetes/sig-node-bugs", "about and and and"),
        ("x [ ] y ( ) z", "x y z"),
        ("a\r\nb\rc\x00d", "a\nb\nc d"),
        ("   many    blanks\t\there  \n\n\n  next  ", "many blanks here\nnext"),
        ("see <https://example.test/x> now", "see now"),
    ],
)
def test_golden_cleaning(spark, raw, expected):
    rows = clean_both_ways(spark, [raw], LABELS_A + ["sig/node"])
    assert rows[0]["g"] == expected
    assert rows[0]["u"] == expected


def test_stepwise_and_single_expression_forms_agree(spark):
    texts = [
        "plain text only",
        "![](x) [a](b) [](c) [ ](d) ![ ](e)",
        "`/sig node` and `/unknown x`",
        "line\n  > /close\nnext\n1) /lgtm\n- [x] /hold",
        "http://a.b/c?d=(e) HTTPS://UP.CASE/x",
        "#1 ##2 x#3 (#4) #5a",
        "tabs\t\tand\x0bvertical\x1cfile sep",
        "kind-bug kind:bug KIND/BUG kindXbug sig-node-x @kubernetes/sig-nodes",
        "<div>\n<br>\n<BR />\n</div>",
        "",
    ]
    for row in clean_both_ways(spark, texts, LABELS_B):
        assert row["g"] == row["u"], row["t"]


def test_long_link_target_does_not_overflow_the_regex_stack(spark):
    target = "a" * 20_000
    texts = [f"[x]({target})", f"![x]({target})", "![" * 5_000, "(b)" * 5_000]
    rows = clean_both_ways(spark, texts, LABELS_A)
    assert rows[0]["g"] == "x"
    assert rows[1]["g"] == "x"


def test_title_key_and_group_id(spark):
    df = spark.createDataFrame([("[sig-node] Kubelet 1.29 fails deadbeef42",), ("",)], "t string")
    out = df.select(T.title_key(F.col("t")).alias("k")).collect()
    assert out[0]["k"] == "sig node kubelet fails"
    assert out[1]["k"] == ""
    ids = df.select(T.split_group_id(F.lit(""), F.lit(7)).alias("g")).collect()
    import hashlib

    assert ids[0]["g"] == "grp_" + hashlib.sha256(b"issue-7").hexdigest()[:16]


def test_empty_catalog_masks_nothing(spark):
    rows = clean_both_ways(spark, ["kind/bug stays"], [])
    assert rows[0]["g"] == "kind/bug stays"


def test_batches_to_python_are_bounded(spark):
    """A worker gets few rows and bytes at once, however much text a task reads; a smaller setting stands."""
    from ticketlens.session import PYTHON_BATCH_ROWS, bounded_batches

    @F.pandas_udf("array<long>")
    def batch(values: pd.Series) -> pd.Series:
        total = [len(values), int(values.str.len().sum())]
        return pd.Series([total] * len(values))

    names = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    try:
        bounded_batches(spark)
        short = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 10).alias("t"))
        long = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
        assert short.select(batch("t").alias("b")).agg(F.max("b")).first()[0][0] <= PYTHON_BATCH_ROWS
        assert long.select(batch("t").alias("b")).agg(F.max(F.col("b")[1])).first()[0] < 10_000_000
        spark.conf.set(names[0], "50")
        assert bounded_batches(spark).conf.get(names[0]) == "50"
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


def test_nfkc_workers_take_arrow_values_without_pandas(spark):
    from pyspark.util import PythonEvalType

    from ticketlens.functions import unicode as U

    assert U._nfkc_batch.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF and not hasattr(U, "pd")
    rows = [(i, v) for i, v in enumerate(["ﬁ Ａ", "plain", "", None, "é"])]
    out = spark.createDataFrame(rows, "i int, t string").select("i", U.nfkc(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in out] == ["fi A", "plain", "", None, "é"]
