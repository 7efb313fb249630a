"""Webhook event triage (F6): accepted / ignored / malformed with a reason.

Payload text is parsed once to VARIANT; every rule is a type or presence test
on a path, evaluated in order as one CASE chain (first match wins). Scalar
type tests use ``schema_of_variant``: an integer is exactly ``BIGINT`` (42.0
is a DECIMAL, true a BOOLEAN), JSON null is ``VOID`` and a missing key is SQL
NULL, so presence and null stay distinct. Object tests extract a one-field
struct, which never builds the schema string of a whole sub-object. Known difference: a payload with
duplicate keys does not parse (it is reported as invalid JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import SUPPORTED_ACTIONS
from ticketlens.functions import variant as VT

ACCEPTED, IGNORED, MALFORMED = "accepted", "ignored", "malformed"


_sub, _kind, _is_object, _is_string = VT.sub, VT.kind, VT.is_object, VT.is_string


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


# (status, reason, condition) in rule order; conditions assume earlier ones failed.
def _rules(v: Column) -> list[tuple[str, str, Column]]:
    return [
        (MALFORMED, "invalid_json", v.isNull()),
        (MALFORMED, "not_object", ~_is_object(v, "$")),
        (MALFORMED, "missing_issue", ~_is_object(v, "$.issue")),
        (IGNORED, "pull_request", _sub(v, "$.issue.pull_request").isNotNull()),
        (MALFORMED, "missing_action", ~_is_string(v, "$.action")),
        (IGNORED, "unsupported_action", ~_text(v, "$.action").isin(*SUPPORTED_ACTIONS)),
        (IGNORED, "bot_author", F.coalesce(_is_string(v, "$.issue.user.type") & (_text(v, "$.issue.user.type") == "Bot"), F.lit(False))),
        (IGNORED, "bot_sender", F.coalesce(_is_string(v, "$.sender.type") & (_text(v, "$.sender.type") == "Bot"), F.lit(False))),
        (MALFORMED, "missing_repository", ~_is_object(v, "$.repository")),
        (MALFORMED, "missing_owner", ~_is_object(v, "$.repository.owner")),
        (MALFORMED, "invalid_repository", ~(_is_string(v, "$.repository.owner.login") & _is_string(v, "$.repository.name"))),
        (MALFORMED, "invalid_number", ~F.coalesce(_kind(v, "$.issue.number") == "BIGINT", F.lit(False))),
        (MALFORMED, "invalid_title_or_url", ~(_is_string(v, "$.issue.title") & _is_string(v, "$.issue.html_url"))),
        (MALFORMED, "invalid_body", ~F.coalesce(_kind(v, "$.issue.body").isin("STRING", "VOID"), F.lit(True))),
    ]


def parse_payload(payload: Column) -> Column:
    return F.try_parse_json(payload)


def triage_events(events: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Add status, reason and the event fields (fields are NULL unless accepted)."""
    parsed = events.withColumn("_v", parse_payload(F.col(payload_col)))
    v = F.col("_v")
    status, reason = None, None
    for st, rs, cond in _rules(v):
        status = F.when(cond, F.lit(st)) if status is None else status.when(cond, F.lit(st))
        reason = F.when(cond, F.lit(rs)) if reason is None else reason.when(cond, F.lit(rs))
    status = status.otherwise(F.lit(ACCEPTED))
    reason = reason.otherwise(F.lit(None).cast("string"))
    staged = parsed.withColumn("status", status).withColumn("reason", reason)
    ok = F.col("status") == ACCEPTED

    def field(path: str, dtype: str = "string") -> Column:
        return F.when(ok, F.variant_get(v, path, dtype))

    return staged.select(
        *[c for c in events.columns if c != payload_col],
        "status",
        "reason",
        field("$.repository.owner.login").alias("owner"),
        field("$.repository.name").alias("repo"),
        field("$.issue.number", "bigint").alias("issue_number"),
        field("$.issue.title").alias("title"),
        F.when(ok, F.try_variant_get(v, "$.issue.body", "string")).alias("body"),
        field("$.action").alias("action"),
        field("$.issue.html_url").alias("html_url"),
    )


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Counts per (status, reason); their sum is the number of events in."""
    return triaged.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("events"))


def scan_payloads(events: DataFrame, payload_col: str = "payload") -> DataFrame:  # S2 checks
    """Per payload: readable JSON? an object? and its top-level keys."""
    v = parse_payload(F.col(payload_col))
    obj = VT.is_object(v)
    parse_status = (
        F.when(v.isNull(), F.lit("invalid_json"))
        .when(~obj, F.lit("not_object"))
        .otherwise(F.lit("ok"))
    )
    keys = F.when(obj, F.array_join(F.array_sort(F.map_keys(
        F.try_variant_get(v, "$", "map<string,variant>"))), ","))
    return events.select(
        *[c for c in events.columns if c != payload_col],
        parse_status.alias("parse_status"),
        keys.alias("top_level_keys"),
    )
