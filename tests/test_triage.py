"""Event triage (F6) outcomes, mirroring the reference's event tests."""

from __future__ import annotations

import json

import pytest

from ticketlens.operators.triage import scan_payloads, triage_events

BASE_ISSUE = {"number": 42, "title": "Bug in scheduling", "body": "Detailed description here",
              "html_url": "https://github.com/kubernetes/kubernetes/issues/42", "user": {"login": "alice", "type": "User"}}
REPO = {"name": "kubernetes", "owner": {"login": "kubernetes"}}


def payload(**over):
    p = {"action": "opened", "issue": dict(BASE_ISSUE), "repository": REPO}
    for k, v in over.items():
        if k.startswith("issue_"):
            key = k[len("issue_"):]
            if v is KeyError:
                p["issue"].pop(key, None)
            else:
                p["issue"][key] = v
        elif v is KeyError:
            p.pop(k, None)
        else:
            p[k] = v
    return json.dumps(p)


CASES = [
    ("valid", payload(), "accepted", None),
    ("null_body", payload(issue_body=None, action="edited"), "accepted", None),
    ("missing_body", payload(issue_body=KeyError), "accepted", None),
    ("closed", payload(action="closed"), "ignored", "unsupported_action"),
    ("pr_empty", payload(issue_pull_request={}), "ignored", "pull_request"),
    ("pr_null", payload(issue_pull_request=None), "ignored", "pull_request"),
    ("bot_user", payload(issue_user={"type": "Bot"}), "ignored", "bot_author"),
    ("bot_sender", payload(sender={"type": "Bot"}), "ignored", "bot_sender"),
    ("no_issue", payload(issue=KeyError), "malformed", "missing_issue"),
    ("issue_list", json.dumps({"action": "opened", "issue": []}), "malformed", "missing_issue"),
    ("list_body", payload(issue_body=["unexpected"]), "malformed", "invalid_body"),
    ("bool_number", payload(issue_number=True), "malformed", "invalid_number"),
    ("float_number", payload(issue_number=42.0), "malformed", "invalid_number"),
    ("no_action", payload(action=KeyError), "malformed", "missing_action"),
    ("numeric_action", payload(action=3), "malformed", "missing_action"),
    ("no_repo", payload(repository=KeyError), "malformed", "missing_repository"),
    ("no_owner", payload(repository={"name": "r"}), "malformed", "missing_owner"),
    ("owner_login_int", payload(repository={"name": "r", "owner": {"login": 1}}), "malformed", "invalid_repository"),
    ("title_int", payload(issue_title=5), "malformed", "invalid_title_or_url"),
    ("no_url", payload(issue_html_url=KeyError), "malformed", "invalid_title_or_url"),
    ("not_json", "not json", "malformed", "invalid_json"),
    ("array", "[]", "malformed", "not_object"),
    # rule order: a pull request wins over a bad action; a bot wins over a bad repository
    ("pr_before_action", payload(issue_pull_request={}, action=7), "ignored", "pull_request"),
    ("bot_before_repo", payload(issue_user={"type": "Bot"}, repository=KeyError), "ignored", "bot_author"),
]


@pytest.fixture(scope="module")
def triaged(spark):
    df = spark.createDataFrame([(i, p) for i, (_, p, _, _) in enumerate(CASES)], "event_id long, payload string")
    return {r["event_id"]: r for r in triage_events(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_triage_outcome(triaged, i):
    _, _, status, reason = CASES[i]
    assert (triaged[i]["status"], triaged[i]["reason"]) == (status, reason)


def test_accepted_fields(triaged):
    row = triaged[0]
    assert (row["owner"], row["repo"], row["issue_number"], row["title"], row["body"], row["action"]) == (
        "kubernetes", "kubernetes", 42, "Bug in scheduling", "Detailed description here", "opened")
    assert triaged[1]["body"] is None and triaged[1]["action"] == "edited"


def test_rejected_rows_carry_no_fields(triaged):
    assert triaged[3]["owner"] is None and triaged[3]["title"] is None


def test_fixture_view_counts(spark):
    """The derived payload view has a known outcome mix (every event counted once)."""
    from ticketlens.operators.triage import triage_summary
    from ticketlens.sources import testdata as td

    summary = {(r["status"], r["reason"]): r["events"]
               for r in triage_summary(triage_events(td.event_payloads(spark, "/root/testdata/sf0.01"))).collect()}
    assert sum(summary.values()) == 10_000
    assert summary[("accepted", None)] == 4_131
    for reason in ("invalid_json", "not_object", "missing_issue", "invalid_number", "invalid_body"):
        assert summary[("malformed", reason)] == 500
    assert summary[("ignored", "unsupported_action")] == 1_291
    assert summary[("ignored", "pull_request")] == 1_071
    assert summary[("ignored", "bot_author")] == 510
    assert summary[("ignored", "bot_sender")] == 497


def test_scan_payloads(spark):
    df = spark.createDataFrame([(1, "nope"), (2, "[1]"), (3, '{"b":1,"a":2}')], "event_id long, payload string")
    got = {r["event_id"]: (r["parse_status"], r["top_level_keys"]) for r in scan_payloads(df).collect()}
    assert got == {1: ("invalid_json", None), 2: ("not_object", None), 3: ("ok", "a,b")}


def test_event_files_wholetext(spark, tmp_path):
    from ticketlens.sources.events import read_event_files

    (tmp_path / "a.json").write_text(json.dumps(json.loads(payload()), indent=2))
    (tmp_path / "b.json").write_text("{broken")
    df = read_event_files(spark, str(tmp_path))
    got = sorted((r["event_path"].rsplit("/", 1)[-1], r["status"]) for r in triage_events(df).collect())
    assert got == [("a.json", "accepted"), ("b.json", "malformed")]
