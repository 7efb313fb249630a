"""Oracle SQL (DuckDB) for the registered queries.

Each entry computes the same result as ``queries.py`` with independent SQL on
the same parquet tables (pre-registered as views). Column names match.
"""

from __future__ import annotations

from ticketlens import oracle_text as X
from ticketlens.fixed_values import LABEL_CATALOG
from ticketlens.functions.labels import target_columns
from ticketlens.sources import testdata as td

LABELS = [label for label, _, _ in LABEL_CATALOG]
ORACLES: dict[str, str] = {}

CATALOG_LIST = td.render(td.catalog_list_sql(), "duckdb")


def _issues_cte(**more: str) -> str:
    return td.duck_cte(issues=td.ISSUES, **more)


# --- text stages --------------------------------------------------------------

_STAGES = {
    "clean_newlines": X.t_newlines,
    "strip_html_comments": X.t_comments,
    "strip_command_lines": X.t_command_lines,
    "strip_inline_commands": X.t_inline_commands,
    "mask_label_mentions": lambda e: X.t_labels(e, LABELS),
    "strip_md_images": X.t_images,
    "strip_md_links": X.t_links,
    "strip_html": X.t_html,
    "mask_urls": X.t_urls,
    "mask_issue_refs": X.t_issue_refs,
    "strip_empty_brackets": X.t_empty_brackets,
    "strip_control": X.t_control,
    "normalize_lines": X.t_lines,
    "clean_field": lambda e: X.clean(e, LABELS),
}

for _name, _fn in _STAGES.items():
    ORACLES[_name] = (
        td.duck_cte(texts=td.TEXTS)
        + f"SELECT src, id, {_fn('coalesce(text, ' + chr(39) * 2 + ')')} AS result FROM texts"
    )


def _nfkc_oracle() -> str:
    back = f"translate(text, {X.q(td.FULL_WIDTH)}, {X.q(td.ASCII_PRINTABLE)})"
    for plain, joined in td.LIGATURES:
        back = f"replace({back}, {X.q(joined)}, {X.q(plain)})"
    back = f"replace({back}, {X.q(td.NBSP)}, ' ')"
    return td.duck_cte(compat=td.COMPAT_TEXTS) + f"SELECT doc_id, {back} AS result FROM compat"


ORACLES["clean_nfkc"] = _nfkc_oracle()

_CLEANED = (
    f"SELECT number, {X.clean('title', LABELS)} AS clean_title, {X.clean('body', LABELS)} AS clean_body FROM issues"
)

ORACLES["model_input"] = (
    _issues_cte() + f", c AS ({_CLEANED})\nSELECT number, {X.model_input('clean_title', 'clean_body')} AS model_input FROM c"
)
ORACLES["title_key"] = _issues_cte() + f", c AS ({_CLEANED})\nSELECT number, {X.title_key('clean_title')} AS title_key FROM c"
ORACLES["split_group"] = (
    _issues_cte()
    + f", c AS ({_CLEANED})\nSELECT number, {X.group_id(X.title_key('clean_title'), 'number')} AS split_group_id FROM c"
)


# --- dataset rows ---------------------------------------------------------------


def _rows_select(source: str) -> str:
    """Dataset row columns over a relation with number/title/body/created_at/html_url/retained."""
    targets = ",\n  ".join(
        f"CAST(list_contains(retained, {X.q(label)}) AS INTEGER) AS {name}"
        for label, name in zip(LABELS, target_columns(LABELS))
    )

    def tax(prefix: str) -> str:
        return f"array_to_string(list_filter(retained, lambda x: starts_with(x, {X.q(prefix)})), '|')"

    return f"""
SELECT concat('github_issue_', CAST(number AS VARCHAR)) AS sample_id,
  number AS issue_number,
  coalesce(html_url, concat('https://github.com/kubernetes/kubernetes/issues/', CAST(number AS VARCHAR))) AS issue_url,
  created_at AS issue_created_at,
  clean_title AS cleaned_issue_title,
  clean_body AS cleaned_issue_body,
  {X.model_input('clean_title', 'clean_body')} AS model_input,
  {tax('kind/')} AS kind_labels,
  {tax('sig/')} AS sig_labels,
  {tax('area/')} AS area_labels,
  array_to_string(retained, '|') AS retained_labels,
  CAST(len(retained) AS INTEGER) AS retained_label_count,
  {X.group_id(X.title_key('clean_title'), 'number')} AS split_group_id,
  {targets}
FROM (SELECT *, {X.clean('title', LABELS)} AS clean_title, {X.clean('body', LABELS)} AS clean_body FROM {source}) s
"""


_RETAINED = f"SELECT *, list_sort(list_intersect(labels, {CATALOG_LIST})) AS retained FROM issues"

ORACLES["build_rows"] = _issues_cte() + f", r AS ({_RETAINED})\n" + _rows_select("r")
ORACLES["collect_rows"] = _issues_cte() + f", r AS ({_RETAINED} WHERE len(list_intersect(labels, {CATALOG_LIST})) > 0)\n" + _rows_select("r")


def _us(expr: str) -> str:
    return f"epoch_us(CASE WHEN regexp_matches({expr}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN try_cast({expr} AS TIMESTAMPTZ) END)"


def _dbl(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def split_sql(rows_cte: str, v: float, l: float) -> str:
    """Assign final_split over relation ``rows`` (needs created_us, split_group_id)."""
    fv, fl = 1.0 - v - l, 1.0 - l
    return f"""{rows_cte},
n AS (SELECT count(*) AS n FROM rows),
ordered AS (SELECT created_us, row_number() OVER (ORDER BY created_us) - 1 AS rk FROM rows),
fr AS (SELECT * FROM (VALUES ('validation', {_dbl(fv)}), ('lockbox', {_dbl(fl)})) t(name, f)),
pos AS (SELECT name, (n - 1) * f AS p, floor((n - 1) * f) AS lo, least(floor((n - 1) * f) + 1, n - 1) AS hi FROM fr, n),
vals AS (SELECT name, p - lo AS w,
           (SELECT created_us FROM ordered WHERE rk = lo) AS a,
           (SELECT created_us FROM ordered WHERE rk = hi) AS b FROM pos),
secs AS (SELECT name, (a / CAST(1000000 AS DOUBLE)) * (CAST(1 AS DOUBLE) - w) + (b / CAST(1000000 AS DOUBLE)) * w AS s FROM vals),
cuts AS (SELECT name, CAST(trunc(s) AS BIGINT) * 1000000 + CAST(round_even((s - trunc(s)) * CAST(1000000 AS DOUBLE), 0) AS BIGINT) AS cut_us FROM secs),
grp AS (SELECT split_group_id AS g, max(created_us) AS latest FROM rows GROUP BY 1)
SELECT rows.* EXCLUDE (created_us),
  CASE WHEN latest >= (SELECT cut_us FROM cuts WHERE name = 'lockbox') THEN 'lockbox'
       WHEN latest >= (SELECT cut_us FROM cuts WHERE name = 'validation') THEN 'validation'
       ELSE 'train' END AS final_split
FROM rows JOIN grp ON rows.split_group_id = grp.g
"""


def build_dataset_sql(created_after_us: int, closed_before_us: int, v: float, l: float, where: str = "true") -> str:
    windowed = f"""SELECT * FROM issues
WHERE NOT coalesce(is_pull_request, false) AND created_at IS NOT NULL AND closed_at IS NOT NULL
  AND {_us('created_at')} >= {created_after_us} AND {_us('created_at')} <= {closed_before_us}
  AND {_us('closed_at')} <= {closed_before_us} AND {where}
  AND len(list_intersect(labels, {CATALOG_LIST})) > 0"""
    rows = (
        _issues_cte()
        + f", r AS (SELECT *, list_sort(list_intersect(labels, {CATALOG_LIST})) AS retained FROM ({windowed}) w),\n"
        + f"rows AS (SELECT *, {_us('issue_created_at')} AS created_us FROM ({_rows_select('r')}) x)"
    )
    return split_sql(rows, v, l)


def _register_dataset() -> None:
    from ticketlens import queries as Q
    from ticketlens.operators.filters import instant_micros

    ORACLES["build_dataset"] = build_dataset_sql(
        instant_micros(Q.CREATED_AFTER), instant_micros(Q.CLOSED_BEFORE), Q.VALIDATION_FRACTION, Q.LOCKBOX_FRACTION
    )


_register_dataset()


# --- events, scoring, plans ------------------------------------------------------

from ticketlens.fixed_values import DEVELOPMENT_KEYWORDS, SUPPORTED_ACTIONS  # noqa: E402

_KW = dict(DEVELOPMENT_KEYWORDS)


def _jt(path: str) -> str:
    return f"coalesce(json_type(j, {X.q(path)}), '')"


_TRIAGE_RULES = [
    ("malformed", "invalid_json", "j IS NULL"),
    ("malformed", "not_object", "json_type(j) <> 'OBJECT'"),
    ("malformed", "missing_issue", f"{_jt('$.issue')} <> 'OBJECT'"),
    ("ignored", "pull_request", "json_exists(j, '$.issue.pull_request')"),
    ("malformed", "missing_action", f"{_jt('$.action')} <> 'VARCHAR'"),
    ("ignored", "unsupported_action",
     "json_extract_string(j, '$.action') NOT IN (" + ", ".join(X.q(a) for a in SUPPORTED_ACTIONS) + ")"),
    ("ignored", "bot_author", f"{_jt('$.issue.user.type')} = 'VARCHAR' AND json_extract_string(j, '$.issue.user.type') = 'Bot'"),
    ("ignored", "bot_sender", f"{_jt('$.sender.type')} = 'VARCHAR' AND json_extract_string(j, '$.sender.type') = 'Bot'"),
    ("malformed", "missing_repository", f"{_jt('$.repository')} <> 'OBJECT'"),
    ("malformed", "missing_owner", f"{_jt('$.repository.owner')} <> 'OBJECT'"),
    ("malformed", "invalid_repository",
     f"NOT ({_jt('$.repository.owner.login')} = 'VARCHAR' AND {_jt('$.repository.name')} = 'VARCHAR')"),
    ("malformed", "invalid_number", f"{_jt('$.issue.number')} NOT IN ('UBIGINT', 'BIGINT')"),
    ("malformed", "invalid_title_or_url",
     f"NOT ({_jt('$.issue.title')} = 'VARCHAR' AND {_jt('$.issue.html_url')} = 'VARCHAR')"),
    ("malformed", "invalid_body", f"{_jt('$.issue.body')} NOT IN ('', 'VARCHAR', 'NULL')"),
]


def _case(index: int) -> str:
    whens = " ".join(f"WHEN {cond} THEN {X.q(rule[index])}" for *rule, cond in [(a, b, c) for a, b, c in _TRIAGE_RULES])
    default = "'accepted'" if index == 0 else "NULL"
    return f"CASE {whens} ELSE {default} END"


def _acc(expr: str) -> str:
    return f"CASE WHEN status = 'accepted' THEN {expr} END"


TRIAGED = (
    td.duck_cte(event_payloads=td.EVENT_PAYLOADS)
    + ", p AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM event_payloads),\n"
    + f"t AS (SELECT event_id, j, {_case(0)} AS status, {_case(1)} AS reason FROM p),\n"
    + "triaged AS (SELECT event_id, status, reason, "
    + _acc("json_extract_string(j, '$.repository.owner.login')") + " AS owner, "
    + _acc("json_extract_string(j, '$.repository.name')") + " AS repo, "
    + _acc("CAST(json_extract_string(j, '$.issue.number') AS BIGINT)") + " AS issue_number, "
    + _acc("json_extract_string(j, '$.issue.title')") + " AS title, "
    + _acc("json_extract_string(j, '$.issue.body')") + " AS body, "
    + _acc("json_extract_string(j, '$.action')") + " AS action, "
    + _acc("json_extract_string(j, '$.issue.html_url')") + " AS html_url FROM t)\n"
)

ORACLES["event_triage"] = TRIAGED + "SELECT * FROM triaged"
ORACLES["event_triage_summary"] = TRIAGED + "SELECT status, reason, count(*) AS events FROM triaged GROUP BY ALL"
ORACLES["scan_events"] = (
    td.duck_cte(event_payloads=td.EVENT_PAYLOADS)
    + ", p AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM event_payloads)\n"
    + "SELECT event_id, CASE WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' ELSE 'ok' END AS parse_status,\n"
    + "  CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_sort(json_keys(j)), ',') END AS top_level_keys FROM p"
)


def _hit(mi: str, label: str) -> str:
    words = _KW.get(label, ())
    return "(" + " OR ".join(f"contains(lower({mi}), {X.q(w)})" for w in words) + ")" if words else "false"


def _kw_score(mi: str, label: str) -> str:
    return f"CASE WHEN {_hit(mi, label)} THEN CAST('0.9' AS DOUBLE) ELSE CAST('0.1' AS DOUBLE) END"


def _selected_list(mi: str, extra: str = "") -> str:
    parts = []
    for i, (label, _tax, thr) in enumerate(LABEL_CATALOG):
        cond = f"{_kw_score(mi, label)} >= {_dbl(thr)}"
        if extra:
            cond += " AND " + extra.format(ord=i)
        parts.append(f"CASE WHEN {cond} THEN {X.q(label)} END")
    return "concat_ws('|', " + ", ".join(parts) + ")"


_REPO_R = "CASE WHEN owner = 'org' AND repo LIKE 'repo%' THEN TRY_CAST(substr(repo, 5) AS INTEGER) END"

PLAN = (
    TRIAGED
    + ", s AS (SELECT *, " + _acc(X.model_input(X.clean("title", LABELS), X.clean("body", LABELS))) + " AS model_input FROM triaged),\n"
    + f"s2 AS (SELECT *, coalesce({_selected_list('model_input')}, '') AS labels_to_apply,\n"
    + f"  coalesce({_selected_list('model_input', '((({ord}) + ' + _REPO_R + ') % 7 = 0)')}, '') AS missing_labels FROM s),\n"
    + "plan AS (SELECT *, CASE WHEN status = 'ignored' THEN 'ignored' WHEN status = 'malformed' THEN 'malformed'\n"
    + "  WHEN labels_to_apply = '' THEN 'no_labels' WHEN missing_labels <> '' THEN 'missing_labels' ELSE 'apply' END AS write_status FROM s2)\n"
)
_EXIT = "CASE WHEN write_status IN ('malformed', 'missing_labels', 'blocked_dev') THEN 1 ELSE 0 END AS exit_code"

ORACLES["triage_issues"] = PLAN + (
    "SELECT event_id, status, reason, owner, repo, issue_number, model_input, labels_to_apply, missing_labels, "
    f"write_status, {_EXIT}, '1.0.0 (non-production)' AS model_version, 'development' AS backend FROM plan"
)
ORACLES["label_write_plan"] = PLAN + (
    f"SELECT event_id, owner, repo, issue_number, labels_to_apply, write_status, {_EXIT} FROM plan"
)
ORACLES["missing_repo_labels"] = PLAN + (
    "SELECT event_id, owner, repo, unnest(string_split(missing_labels, '|')) AS label FROM plan WHERE missing_labels <> ''"
)

_CAT_KW = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {X.q(label)}, {X.q(tax)}, {_dbl(thr)})" for i, (label, tax, thr) in enumerate(LABEL_CATALOG)
) + ") AS t(ord, label, taxonomy, threshold)"

ORACLES["dry_run_report"] = (
    TRIAGED
    + ", s AS (SELECT *, " + _acc(X.model_input(X.clean("title", LABELS), X.clean("body", LABELS))) + " AS model_input FROM triaged),\n"
    + f"cat AS ({_CAT_KW}),\n"
    + "pairs AS (SELECT s.event_id, cat.label, cat.threshold, CASE "
    + " ".join(f"WHEN cat.label = {X.q(label)} THEN {_kw_score('s.model_input', label)}" for label in LABELS)
    + " END AS score FROM s JOIN cat ON s.status = 'accepted')\n"
    + "SELECT event_id, label, round(score, 4) AS score, threshold FROM pairs WHERE score >= threshold"
)

_CLEANED_MI = f"SELECT number, {X.model_input(X.clean('title', LABELS), X.clean('body', LABELS))} AS mi FROM issues"
ORACLES["score_keywords"] = (
    _issues_cte()
    + f", c AS ({_CLEANED_MI}), cat AS ({_CAT_KW})\n"
    + "SELECT c.number, cat.ord AS pos, cat.label, cat.taxonomy, CASE "
    + " ".join(f"WHEN cat.label = {X.q(label)} THEN {_kw_score('c.mi', label)}" for label in LABELS)
    + " END AS score, '1.0.0 (non-production)' AS model_version, 'development' AS backend FROM c JOIN cat ON true"
)

_POS = (
    f"cat AS ({_CAT_KW}),\n"
    "e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),\n"
    "raw AS (SELECT e.vec_id, CAST(e.pos AS INTEGER) AS pos, CAST(e.x AS DOUBLE) AS x,\n"
    "  CASE WHEN e.pos < 60 THEN c30.label ELSE concat('priority/p', CAST(e.pos AS VARCHAR)) END AS label,\n"
    "  CASE WHEN e.pos < 30 THEN c30.taxonomy ELSE 'kind' END AS taxonomy,\n"
    "  1.0 / (1.0 + exp(-CAST(e.x AS DOUBLE))) AS score\n"
    "  FROM e LEFT JOIN cat c30 ON c30.ord = e.pos % 30),\n"
    "lg AS (SELECT vec_id, CAST(pos % 30 AS INTEGER) AS pos, sum(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),\n"
    "raw30 AS (SELECT lg.vec_id, lg.pos, cat.label, cat.taxonomy, 1.0 / (1.0 + exp(-lg.x)) AS score FROM lg JOIN cat ON cat.ord = lg.pos)\n"
)
ORACLES["score_logits"] = (
    "WITH " + _POS
    + "SELECT vec_id, pos, label, taxonomy, round(score, 9) AS score FROM raw30"
)
ORACLES["postprocess"] = (
    "WITH " + _POS
    + "SELECT raw.vec_id, raw.pos, cat.ord, raw.label, raw.taxonomy, round(raw.score, 9) AS score, cat.threshold,\n"
    + "  raw.score >= cat.threshold AS selected FROM raw JOIN cat ON raw.label = cat.label AND raw.taxonomy = cat.taxonomy"
)
ORACLES["rejected_predictions"] = (
    "WITH " + _POS
    + "SELECT raw.vec_id, raw.pos, raw.label, raw.taxonomy,\n"
    + "  CASE WHEN cat.label IS NULL THEN 'unknown_label' ELSE 'taxonomy_mismatch' END AS reason\n"
    + "FROM raw LEFT JOIN cat ON raw.label = cat.label WHERE cat.label IS NULL OR cat.taxonomy <> raw.taxonomy"
)
ORACLES["threshold_predictions"] = (
    "WITH " + _POS
    + "SELECT raw.vec_id, raw.label, round(raw.score, 9) AS score, cat.threshold, raw.score >= cat.threshold AS selected\n"
    + "FROM raw30 AS raw JOIN cat ON raw.label = cat.label"
)
ORACLES["selected_labels"] = (
    "WITH " + _POS
    + ", chosen AS (SELECT DISTINCT raw.vec_id, cat.ord, raw.label FROM raw JOIN cat ON raw.label = cat.label AND raw.taxonomy = cat.taxonomy\n"
    + "  WHERE raw.score >= cat.threshold),\n"
    + "agg AS (SELECT vec_id, string_agg(label, '|' ORDER BY ord) AS labels FROM chosen GROUP BY vec_id)\n"
    + "SELECT embeddings.vec_id, coalesce(agg.labels, '') AS labels FROM embeddings LEFT JOIN agg ON embeddings.vec_id = agg.vec_id"
)
ORACLES["repo_labels"] = (
    f"WITH cat AS ({_CAT_KW}),\n"
    "repos AS (SELECT DISTINCT 'org' AS owner, concat('repo', CAST(user_id % 5 AS VARCHAR)) AS repo, user_id % 5 AS r FROM events)\n"
    "SELECT owner, repo, label FROM repos JOIN cat ON (cat.ord + repos.r) % 7 <> 0"
)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
