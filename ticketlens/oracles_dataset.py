"""Oracle SQL for the dataset build's parts (see ``queries_dataset.py``)."""

from __future__ import annotations

from ticketlens import oracle_text as X
from ticketlens.functions.labels import target_columns  # noqa: F401
from ticketlens.functions.tokens import head_tail_sizes
from ticketlens.operators.filters import instant_micros
from ticketlens.oracles import (
    CATALOG_LIST,
    LABELS,
    ORACLES,
    _CAT_KW,
    _issues_cte,
    _rows_select,
    _us,
    build_dataset_sql,
    split_sql,
)
from ticketlens.plans.dataset import dataset_columns
from ticketlens.queries import CLOSED_BEFORE, CREATED_AFTER, FIRST_N, LOCKBOX_FRACTION, VALIDATION_FRACTION
from ticketlens.queries_dataset import BATCH, DAY_WINDOW, MAX_LENGTH, SPECIALS

_LABELED = f"len(list_intersect(labels, {CATALOG_LIST})) > 0"
_RET = f"list_sort(list_intersect(labels, {CATALOG_LIST}))"

# --- S1 / F7 / S6 ----------------------------------------------------------------

ORACLES["scan_issues"] = _issues_cte() + """
SELECT number // 100 AS page,
  CAST(row_number() OVER (PARTITION BY number // 100 ORDER BY number) - 1 AS INTEGER) AS item_pos,
  CASE WHEN number % 23 = 0 THEN NULL ELSE number END AS number,
  CASE WHEN number % 29 = 0 THEN NULL ELSE title END AS title,
  CASE WHEN number % 31 = 0 THEN NULL ELSE body END AS body,
  CASE WHEN body IS NULL THEN 'VOID' WHEN number % 31 = 0 THEN 'BIGINT' ELSE 'STRING' END AS body_kind,
  CASE WHEN number % 19 = 0 THEN regexp_replace(created_at, 'Z$', '') ELSE created_at END AS created_at,
  closed_at, html_url,
  array_to_string(list_transform(labels, lambda x: coalesce(x, '~')), '|') AS labels,
  is_pull_request
FROM issues"""

ORACLES["invalid_issues"] = _issues_cte() + """
, s AS (SELECT number // 100 AS page, CAST(row_number() OVER (PARTITION BY number // 100 ORDER BY number) - 1 AS INTEGER) AS item_pos,
  CASE WHEN number % 23 = 0 THEN 'number_not_int'
       WHEN number % 29 = 0 THEN 'title_not_string'
       WHEN number % 31 = 0 AND body IS NOT NULL THEN 'body_not_string'
       WHEN number % 19 = 0 THEN 'created_at_not_zoned' END AS reason FROM issues)
SELECT page, item_pos, reason FROM s WHERE reason IS NOT NULL"""

_DAMAGED = "(number % 19 = 0 OR number % 23 = 0 OR number % 29 = 0 OR (number % 31 = 0 AND body IS NOT NULL))"


def _outcomes() -> str:
    """Issues with the outcome of the build over the damaged pages."""
    lo, hi = instant_micros(CREATED_AFTER), instant_micros(CLOSED_BEFORE)
    return _issues_cte() + f"""
, o AS (SELECT number // 100 AS page, CAST(row_number() OVER (PARTITION BY number // 100 ORDER BY number) - 1 AS INTEGER) AS item_pos,
  CASE WHEN is_pull_request THEN 'pull_request' WHEN closed_at IS NULL THEN 'no_dates'
       WHEN number % 19 = 0 THEN 'invalid:created_at_not_zoned'
       WHEN {_us('created_at')} < {lo} OR {_us('created_at')} > {hi} OR {_us('closed_at')} > {hi} THEN 'outside_window'
       WHEN number % 23 = 0 THEN 'invalid:number_not_int' WHEN number % 29 = 0 THEN 'invalid:title_not_string'
       WHEN number % 31 = 0 AND body IS NOT NULL THEN 'invalid:body_not_string'
       WHEN NOT ({_LABELED}) THEN 'unlabeled' ELSE 'accepted' END AS outcome FROM issues)
"""


ORACLES["build_outcomes"] = _outcomes() + "SELECT outcome, count(*) AS issues FROM o GROUP BY outcome"
ORACLES["build_quarantine"] = _outcomes() + "SELECT page, item_pos, outcome[9:] AS reason FROM o WHERE starts_with(outcome, 'invalid:')"
ORACLES["build_dataset_from_pages"] = build_dataset_sql(
    instant_micros(CREATED_AFTER), instant_micros(CLOSED_BEFORE), VALIDATION_FRACTION, LOCKBOX_FRACTION, f"NOT {_DAMAGED}"
)

ORACLES["issue_lookup"] = _issues_cte() + """
, wanted AS (SELECT DISTINCT event_id * 7 % 1500 AS number FROM events)
SELECT number, title, body FROM issues
WHERE number IN (SELECT number FROM wanted) AND NOT is_pull_request AND title IS NOT NULL"""

# --- filters -----------------------------------------------------------------------

_LO, _HI = instant_micros(CREATED_AFTER), instant_micros(CLOSED_BEFORE)
ORACLES["filter_pull_requests"] = _issues_cte() + "SELECT number FROM issues WHERE NOT coalesce(is_pull_request, false)"
ORACLES["filter_date_window"] = _issues_cte() + f"""
SELECT number FROM issues WHERE created_at IS NOT NULL AND closed_at IS NOT NULL
  AND {_us('created_at')} >= {_LO} AND {_us('created_at')} <= {_HI} AND {_us('closed_at')} <= {_HI}"""
_FROM, _TO = map(instant_micros, DAY_WINDOW)
ORACLES["filter_date_window_landed"] = ORACLES["stream_landed_window"] = _issues_cte() + f"""
SELECT number, created_at FROM issues WHERE created_at IS NOT NULL AND closed_at IS NOT NULL
  AND {_us('created_at')} >= {_FROM} AND {_us('created_at')} <= {_TO} AND {_us('closed_at')} <= {_TO}"""
ORACLES["filter_labeled"] = _issues_cte() + f"SELECT number FROM issues WHERE {_LABELED}"
ORACLES["first_n_issues"] = _issues_cte() + f"""
SELECT number, created_at FROM issues WHERE {_LABELED}
ORDER BY {_us('created_at')}, number LIMIT {FIRST_N}"""
ORACLES["ordered_dataset"] = _issues_cte() + f"""
SELECT concat('github_issue_', CAST(number AS VARCHAR)) AS sample_id, created_at AS issue_created_at, number AS issue_number
FROM issues WHERE {_LABELED}"""

# --- labels and text helpers -----------------------------------------------------------

ORACLES["retained_labels"] = _issues_cte() + f"SELECT number, array_to_string({_RET}, '|') AS retained_labels FROM issues"
ORACLES["retained_labels_semi"] = _issues_cte() + f"""
, raw AS (SELECT number, unnest(labels) AS label FROM issues)
SELECT DISTINCT number, label FROM raw WHERE label IN (SELECT unnest({CATALOG_LIST}))"""


def _tax(prefix: str) -> str:
    return f"array_to_string(list_filter(r, lambda x: starts_with(x, {X.q(prefix)})), '|')"


ORACLES["taxonomy_labels"] = _issues_cte() + f"""
, t AS (SELECT number, {_RET} AS r FROM issues)
SELECT number, {_tax('kind/')} AS kind_labels, {_tax('sig/')} AS sig_labels, {_tax('area/')} AS area_labels,
  CAST(len(r) AS INTEGER) AS retained_label_count FROM t"""

_targets = ", ".join(
    f"CAST(list_contains(r, {X.q(label)}) AS INTEGER) AS {name}" for label, name in zip(LABELS, target_columns(LABELS))
)
ORACLES["label_targets"] = _issues_cte() + f", t AS (SELECT number, {_RET} AS r FROM issues)\nSELECT number, {_targets} FROM t"


def _target(expr: str) -> str:
    return f"concat('target_', trim(regexp_replace(lower({expr}), '[^a-z0-9]+', '_', 'g'), '_'))"


ORACLES["label_frequency"] = _issues_cte() + f"""
, cat AS ({_CAT_KW}),
counts AS (SELECT label, count(*) AS issues FROM (SELECT unnest({_RET}) AS label FROM issues) GROUP BY label)
SELECT cat.ord, cat.label, cat.taxonomy, cat.threshold, {_target('cat.label')} AS target_column,
  coalesce(counts.issues, 0) AS issues FROM cat LEFT JOIN counts ON cat.label = counts.label"""
ORACLES["target_names"] = _issues_cte() + f"""
, raw AS (SELECT DISTINCT unnest(labels) AS label FROM issues)
SELECT label, {_target('label')} AS target_column FROM raw WHERE label IS NOT NULL"""
ORACLES["catalog_violations"] = _issues_cte() + """
, raw AS (SELECT unnest(labels) AS label FROM issues),
c AS (SELECT label, count(*) AS n FROM raw GROUP BY label)
SELECT label, CASE WHEN label IS NULL THEN 'not_a_string' WHEN label = '' THEN 'empty'
  WHEN NOT (starts_with(label, 'area/') OR starts_with(label, 'kind/') OR starts_with(label, 'sig/')) THEN 'unsupported_taxonomy'
  WHEN n > 1 THEN 'duplicate' END AS rule
FROM c WHERE label IS NULL OR label = '' OR n > 1 OR NOT (starts_with(label, 'area/') OR starts_with(label, 'kind/') OR starts_with(label, 'sig/'))"""

ORACLES["parse_ts"] = _issues_cte() + f"""
, t AS (SELECT number, CASE WHEN number % 4 = 1 THEN regexp_replace(created_at, 'Z$', '+02:00')
  WHEN number % 4 = 2 THEN regexp_replace(created_at, 'Z$', '')
  WHEN number % 16 = 3 THEN regexp_replace(created_at, 'Z$', '+02')
  WHEN number % 16 = 7 THEN regexp_replace(created_at, 'Z$', '+02:00:30')
  WHEN number % 16 = 11 THEN regexp_replace(created_at, '[-:]', '', 'g')
  WHEN number % 4 = 3 THEN regexp_replace(created_at, 'Z$', '.1234567-0530') ELSE created_at END AS raw, created_at FROM issues)
SELECT number, raw, CASE WHEN number % 4 = 2 THEN NULL ELSE {_us('created_at')} + CASE
  WHEN number % 4 = 1 OR number % 16 = 3 THEN -7200000000 WHEN number % 16 = 7 THEN -7230000000 WHEN number % 16 = 11 THEN 0
  WHEN number % 4 = 3 THEN 19800123456 ELSE 0 END END AS created_us FROM t"""
ORACLES["issue_identity"] = _issues_cte() + """
SELECT number, concat('github_issue_', CAST(number AS VARCHAR)) AS sample_id,
  coalesce(html_url, concat('https://github.com/kubernetes/kubernetes/issues/', CAST(number AS VARCHAR))) AS issue_url FROM issues"""

_REF = r"([^/\s]+)/([^#\s]+)#([0-9]+)"
ORACLES["parse_issue_refs"] = f"""
WITH t AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN concat('org/repo', CAST(user_id % 5 AS VARCHAR), '#', CAST(event_id AS VARCHAR))
  WHEN 1 THEN concat('  org/repo', CAST(user_id % 5 AS VARCHAR), '#', CAST(event_id AS VARCHAR), ' ')
  WHEN 2 THEN concat('org/repo', CAST(user_id % 5 AS VARCHAR), CAST(event_id AS VARCHAR))
  WHEN 3 THEN concat('org/repo', CAST(user_id % 5 AS VARCHAR), '#99999999999999999999')
  WHEN 4 THEN concat('org/repo', CAST(user_id % 5 AS VARCHAR), '#', translate(CAST(event_id AS VARCHAR), '0123456789', '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669'))
  ELSE concat('org repo#', CAST(event_id AS VARCHAR)) END AS ref FROM events),
u AS (SELECT event_id, ref, translate(regexp_replace(ref, '^{X.WS}+|{X.WS}+$', '', 'g'),
  '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669', '0123456789') AS s FROM t),
w AS (SELECT *, regexp_full_match(s, '{_REF}') AND try_cast(regexp_extract(s, '{_REF}', 3) AS BIGINT) IS NOT NULL AS ok FROM u)
SELECT event_id, ref,
  CASE WHEN ok THEN regexp_extract(s, '{_REF}', 1) END AS owner,
  CASE WHEN ok THEN regexp_extract(s, '{_REF}', 2) END AS repo,
  CASE WHEN ok THEN try_cast(regexp_extract(s, '{_REF}', 3) AS BIGINT) END AS number
FROM w"""

# --- tokens -------------------------------------------------------------------------------

_BUDGET, _HEAD, _TAIL = head_tail_sizes(MAX_LENGTH, len(SPECIALS))
_ENCODED = f"""
enc AS (SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens,
  list_concat([{X.q(SPECIALS[0])}], CASE WHEN len(t) > {_BUDGET} THEN list_concat(t[1:{_HEAD}], t[-{_TAIL}:]) ELSE t END,
              [{X.q(SPECIALS[1])}]) AS ids
  FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents))"""
ORACLES["head_tail_tokens"] = "WITH " + _ENCODED + """
SELECT doc_id, n_tokens, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ' ') AS ids, CAST(len(ids) AS INTEGER) AS mask_sum FROM enc"""
ORACLES["pad_batches"] = "WITH " + _ENCODED + f"""
, b AS (SELECT doc_id, doc_id // {BATCH} AS batch_id, CAST(len(ids) AS INTEGER) AS n_ids FROM enc),
m AS (SELECT *, CAST(ceil(max(n_ids) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER) AS padded_length FROM b)
SELECT doc_id, batch_id, n_ids, padded_length, padded_length - n_ids AS n_pad, padded_length AS n_input_ids,
  n_ids AS mask_sum FROM m"""

# --- splits ---------------------------------------------------------------------------------

_LABELED_ROWS = (
    _issues_cte()
    + f", r AS (SELECT *, {_RET} AS retained FROM issues WHERE {_LABELED}),\n"
    + f"rows AS (SELECT *, {_us('issue_created_at')} AS created_us FROM ({_rows_select('r')}) x)"
)


def _cuts_sql(rows_cte: str, v: float, l: float) -> str:
    full = split_sql(rows_cte, v, l)
    return full[: full.index("grp AS")].rstrip().rstrip(",") + "\nSELECT name, cut_us FROM cuts"


ORACLES["split_cutoffs"] = _cuts_sql(_LABELED_ROWS, VALIDATION_FRACTION, LOCKBOX_FRACTION)
ORACLES["group_latest"] = _LABELED_ROWS + """
SELECT split_group_id, max(created_us) AS group_latest_us, count(*) AS rows FROM rows GROUP BY split_group_id"""
ORACLES["assign_splits"] = (
    "SELECT sample_id, split_group_id, final_split FROM ("
    + split_sql(_LABELED_ROWS, VALIDATION_FRACTION, LOCKBOX_FRACTION)
    + ") z"
)

_DATASET = build_dataset_sql(_LO, _HI, VALIDATION_FRACTION, LOCKBOX_FRACTION)
ORACLES["dataset_roundtrip"] = _DATASET
ORACLES["split_leakage"] = (
    f"SELECT split_group_id, count(DISTINCT final_split) AS n_splits FROM ({_DATASET}) d GROUP BY 1 HAVING count(DISTINCT final_split) > 1"
)
_LEAK = r"(?i)(^|[^A-Za-z0-9])(?:" + X.label_branches(LABELS) + r")([^A-Za-z0-9]|$)"
_CMD = r"(?im)^[ \t]*(?:>[ \t]*)*(?:(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)?`{0,3}[ \t]*/(?:" + X.CMDS + r")\b"
ORACLES["label_leakage"] = (
    f"SELECT sample_id FROM ({_DATASET}) d WHERE regexp_matches(model_input, {X.q(_LEAK)}) OR regexp_matches(model_input, {X.q(_CMD)})"
)
_HASH = (
    "CAST(('0x' || left(sha256(concat_ws(chr(31), "
    + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in dataset_columns(LABELS)[:-1])
    + ")), 15)) AS BIGINT)"
)
ORACLES["split_digest"] = f"""
WITH d AS ({_DATASET}), h AS (SELECT final_split, {_HASH} AS h FROM d)
SELECT final_split, count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM h GROUP BY 1"""
ORACLES["split_manifest"] = f"""
WITH d AS ({_DATASET}), h AS (SELECT final_split, split_group_id, {_HASH} AS h FROM d),
names AS (SELECT * FROM (VALUES ('train'), ('validation'), ('lockbox')) t(final_split)),
agg AS (SELECT final_split, count(*) AS rows, count(DISTINCT split_group_id) AS groups, bit_xor(h) AS xor_hash,
  CAST(sum(h) AS VARCHAR) AS sum_hash FROM h GROUP BY 1)
SELECT names.final_split, coalesce(agg.rows, 0) AS rows, coalesce(agg.groups, 0) AS groups, coalesce(xor_hash, 0) AS xor_hash,
  coalesce(sum_hash, '0') AS sum_hash, (SELECT count(*) FROM d) AS total_rows, 'kubernetes/kubernetes' AS repository,
  '2024-01-01T00:00:00+00:00' AS created_after, '2024-12-01T00:00:00+00:00' AS closed_before,
  'grouped_creation_time_chronological_strict' AS split_method, CAST('{VALIDATION_FRACTION}' AS DOUBLE) AS validation_fraction,
  CAST('{LOCKBOX_FRACTION}' AS DOUBLE) AS lockbox_fraction, {X.q('|'.join(LABELS))} AS labels
FROM names LEFT JOIN agg ON names.final_split = agg.final_split"""
