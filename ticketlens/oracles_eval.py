"""Oracle SQL for evaluation, the batch scorer and the streaming queries."""

from __future__ import annotations

from ticketlens.operators.evaluate import GRID_STEPS
from ticketlens import oracle_text as X
from ticketlens.oracles import LABELS, ORACLES, PLAN, _CAT_KW, _POS, _kw_score, _selected_list
from ticketlens.queries_eval import RUNS

_TRUTH = """
truth AS (SELECT e.vec_id, c.label FROM embeddings e JOIN cat c ON c.ord = e.label
          UNION SELECT e.vec_id, c.label FROM embeddings e JOIN cat c ON c.ord = (e.label * 3 + 1) % 30),
pred AS (SELECT raw.vec_id, raw.label FROM raw30 AS raw JOIN cat ON raw.label = cat.label
         WHERE raw.score >= cat.threshold),
flags AS (SELECT coalesce(t.vec_id, p.vec_id) AS vec_id, coalesce(t.label, p.label) AS label,
                 CASE WHEN t.vec_id IS NULL THEN 0 ELSE 1 END AS t, CASE WHEN p.vec_id IS NULL THEN 0 ELSE 1 END AS p
          FROM truth t FULL OUTER JOIN pred p ON t.vec_id = p.vec_id AND t.label = p.label)
"""


def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn", rnd: bool = True) -> str:
    def r(x: str) -> str:
        return f"round({x}, 9)" if rnd else x

    return (
        f"{r(f'CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END')} AS precision, "
        f"{r(f'CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END')} AS recall, "
        f"{r(f'CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END')} AS f1"
    )


_BASE = "WITH " + _POS + "," + _TRUTH

_COUNTS = ("CAST(sum(t * p) AS BIGINT) AS tp, CAST(sum((1 - t) * p) AS BIGINT) AS fp, "
           "CAST(sum(t * (1 - p)) AS BIGINT) AS fn")

ORACLES["eval_micro"] = _BASE + f", c AS (SELECT {_COUNTS} FROM flags)\nSELECT tp, fp, fn, {_prf()} FROM c"

_PER_LABEL = (
    f", agg AS (SELECT label, {_COUNTS} FROM flags GROUP BY label),\n"
    "pl AS (SELECT cat.ord, cat.label, cat.taxonomy, cat.threshold, coalesce(agg.tp, 0) AS tp, coalesce(agg.fp, 0) AS fp,\n"
    "  coalesce(agg.fn, 0) AS fn FROM cat LEFT JOIN agg ON cat.label = agg.label)\n"
)
ORACLES["eval_per_label"] = _BASE + _PER_LABEL + f"SELECT ord, label, taxonomy, threshold, tp, fp, fn, tp + fn AS support, {_prf()} FROM pl"
ORACLES["eval_macro"] = (
    _BASE + _PER_LABEL
    + f", f AS (SELECT {_prf(rnd=False)} FROM pl)\nSELECT round(avg(f1), 9) AS macro_f1, count(*) AS labels FROM f"
)
ORACLES["eval_exact_match"] = _BASE + """
, wrong AS (SELECT DISTINCT vec_id FROM flags WHERE t <> p),
n AS (SELECT count(*) AS items FROM embeddings), m AS (SELECT count(*) AS mismatched FROM wrong)
SELECT items, mismatched, round(CASE WHEN items > 0 THEN (items - mismatched) / items ELSE 0.0 END, 9) AS exact_match FROM n, m"""

_SWEEP = _BASE + f"""
, marked AS (SELECT raw.taxonomy, raw.score, CASE WHEN truth.vec_id IS NULL THEN 0 ELSE 1 END AS is_true
            FROM raw30 AS raw LEFT JOIN truth ON raw.vec_id = truth.vec_id AND raw.label = truth.label),
grid AS (SELECT CAST(i AS DOUBLE) / {GRID_STEPS} AS threshold FROM range(0, {GRID_STEPS + 1}) r(i)),
sw AS (SELECT taxonomy, threshold,
  CAST(sum(CASE WHEN score >= threshold AND is_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN score >= threshold AND is_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN score < threshold AND is_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM marked, grid GROUP BY taxonomy, threshold),
scored AS (SELECT taxonomy, threshold, tp, fp, fn, {_prf(rnd=False)} FROM sw)
"""
ORACLES["threshold_sweep"] = _SWEEP + (
    "SELECT taxonomy, threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, "
    "round(f1, 9) AS f1 FROM scored"
)
ORACLES["best_thresholds"] = _SWEEP + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY taxonomy ORDER BY f1 DESC, threshold ASC) AS rk FROM scored)
SELECT taxonomy, threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM ranked WHERE rk = 1"""

_EXACT = f"""
WITH cat AS ({_CAT_KW}),
u AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
lg AS (SELECT vec_id, label AS cls, pos % 30 AS ord, sum(CAST(x AS DOUBLE)) AS score FROM u GROUP BY 1, 2, 3),
pairs AS (SELECT cat.taxonomy, lg.score, CASE WHEN lg.ord = lg.cls OR lg.ord = (lg.cls * 3 + 1) % 30 THEN 1 ELSE 0 END AS is_true
          FROM lg JOIN cat ON cat.ord = lg.ord),
d AS (SELECT taxonomy, score AS threshold, sum(is_true) AS n_true, sum(1 - is_true) AS n_false FROM pairs GROUP BY 1, 2),
sw AS (SELECT taxonomy, threshold, CAST(sum(n_true) OVER top AS BIGINT) AS tp, CAST(sum(n_false) OVER top AS BIGINT) AS fp,
         CAST(sum(n_true) OVER (PARTITION BY taxonomy) - sum(n_true) OVER top AS BIGINT) AS fn
       FROM d WINDOW top AS (PARTITION BY taxonomy ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT taxonomy, threshold, tp, fp, fn, {_prf(rnd=False)} FROM sw)
"""
ORACLES["exact_threshold_sweep"] = _EXACT + """
SELECT taxonomy, threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM scored"""
ORACLES["best_exact_thresholds"] = _EXACT + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY taxonomy ORDER BY f1 DESC, threshold ASC) AS rk FROM scored)
SELECT taxonomy, threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM ranked WHERE rk = 1"""

_RUNS = ", ".join(f"('{m}', {s}, {o})" for m, s, o in RUNS)
ORACLES["seed_comparison"] = f"""
WITH cat AS ({_CAT_KW}),
runs AS (SELECT * FROM (VALUES {_RUNS}) t(model, seed, off)),
u AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
lg AS (SELECT vec_id, pos % 30 AS pos, sum(CAST(x AS DOUBLE)) AS x FROM u GROUP BY 1, 2),
s AS (SELECT r.model, r.seed, lg.vec_id, lg.x, (lg.pos - r.off + 60) % 30 AS ord FROM lg, runs r),
pred AS (SELECT s.model, s.seed, s.vec_id, c.label FROM s JOIN cat c ON c.ord = s.ord
         WHERE 1.0 / (1.0 + exp(-s.x)) >= c.threshold),
truth AS (SELECT r.model, r.seed, e.vec_id, c.label FROM embeddings e, runs r, cat c
          WHERE c.ord = e.label OR c.ord = (e.label * 3 + 1) % 30),
flags AS (SELECT coalesce(t.model, p.model) AS model, coalesce(t.seed, p.seed) AS seed,
                 CASE WHEN t.vec_id IS NULL THEN 0 ELSE 1 END AS t, CASE WHEN p.vec_id IS NULL THEN 0 ELSE 1 END AS p
          FROM truth t FULL OUTER JOIN pred p
          ON t.model = p.model AND t.seed = p.seed AND t.vec_id = p.vec_id AND t.label = p.label),
runf AS (SELECT model, seed, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
         FROM (SELECT model, seed, {_COUNTS} FROM flags GROUP BY model, seed)),
per_model AS (SELECT model, avg(f1) AS mean_metric, count(*) AS seeds FROM runf GROUP BY model),
winners AS (SELECT seed, model FROM (SELECT seed, model, row_number() OVER (PARTITION BY seed ORDER BY f1 DESC, model DESC) AS rk FROM runf) WHERE rk = 1),
wins AS (SELECT model, count(*) AS wins FROM winners GROUP BY model)
SELECT per_model.model, round(mean_metric, 9) AS mean_metric, seeds, coalesce(wins.wins, 0) AS wins,
  round(mean_metric - (SELECT mean_metric FROM per_model WHERE model = 'baseline'), 9) AS delta_to_baseline
FROM per_model LEFT JOIN wins ON per_model.model = wins.model"""

ORACLES["label_catalog"] = _SWEEP + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY taxonomy ORDER BY f1 DESC, threshold ASC) AS rk FROM scored)
SELECT CAST(cat.ord AS INTEGER) AS ord, cat.label, cat.taxonomy, ranked.threshold FROM cat JOIN ranked
  ON cat.taxonomy = ranked.taxonomy AND ranked.rk = 1"""
ORACLES["score_batch"] = ORACLES["score_keywords"]
ORACLES["stream_triage"] = ORACLES["triage_issues"]
ORACLES["stream_replay"] = PLAN + """
SELECT DISTINCT owner, repo, issue_number, label FROM (
  SELECT owner, repo, issue_number, unnest(string_split(labels_to_apply, '|')) AS label FROM plan WHERE write_status = 'apply')"""

ORACLES["tfidf_features"] = f"""
WITH d AS ({ORACLES["build_dataset"]}),
tok AS (SELECT sample_id, final_split, unnest(list_filter(string_split_regex(lower(model_input), '\\W+'), lambda t: t <> '')) AS term FROM d),
tf AS (SELECT sample_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(DISTINCT sample_id) AS df FROM tok WHERE final_split = 'train' GROUP BY term),
n AS (SELECT count(*) AS n FROM d WHERE final_split = 'train')
SELECT sample_id, tf.term, tf, round(tf * ln((n + CAST(1 AS DOUBLE)) / (coalesce(df, 0) + CAST(1 AS DOUBLE))), 9) AS weight
FROM tf LEFT JOIN df ON tf.term = df.term, n"""

ORACLES["validation_sweep"] = f"""
WITH d AS (SELECT * FROM ({ORACLES["build_dataset"]}) x WHERE final_split = 'validation'),
cat AS ({_CAT_KW}),
raw30 AS (SELECT d.sample_id AS vec_id, cat.label, cat.taxonomy, CASE {" ".join(f"WHEN cat.label = {X.q(label)} THEN {_kw_score('d.model_input', label)}" for label in LABELS)} END AS score FROM d, cat),
truth AS (SELECT sample_id AS vec_id, unnest(string_split(retained_labels, '|')) AS label FROM d)
""" + _SWEEP[len(_BASE):] + (
    "SELECT taxonomy, threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, "
    "round(f1, 9) AS f1 FROM scored"
)
ORACLES["bundle_violations"] = """
SELECT * FROM (VALUES ('text_threshold', 'threshold_not_number'), ('threshold_above_one', 'threshold_range'),
  ('threshold_missing', 'threshold_labels'), ('number_label', 'labels_not_ordered_list'), ('number_label', 'schema_manifest_order'),
  ('number_label', 'threshold_labels'), ('label_twice', 'duplicate_manifest_labels'), ('label_twice', 'schema_manifest_order'),
  ('label_twice', 'threshold_labels'), ('other_order', 'schema_manifest_order'), ('number_taxonomy', 'schema_label_not_typed'),
  ('number_taxonomy', 'invalid_taxonomy'), ('wrong_taxonomy', 'invalid_taxonomy'), ('short_input', 'invalid_max_length'),
  ('text_length', 'invalid_max_length'), ('no_version', 'missing_model_version'), ('old_contract', 'preprocessing_version')) t(bundle, rule)"""
ORACLES["stream_event_files"] = f"""
WITH t AS (SELECT item_id AS issue_number, concat('kubelet bug ', CAST(item_id AS VARCHAR)) AS title, text AS body FROM benchmark),
s AS (SELECT issue_number, {X.model_input(X.clean('title', LABELS), X.clean('body', LABELS))} AS model_input FROM t)
SELECT issue_number, 'accepted' AS status, model_input, {_selected_list('model_input')} AS labels_to_apply, 'dry_run' AS write_status FROM s"""
ORACLES["write_gates"] = PLAN + """
, rows AS (SELECT status, true AS from_event, labels_to_apply, missing_labels FROM plan
  UNION ALL SELECT status, false, labels_to_apply, missing_labels FROM plan WHERE status = 'accepted'),
cfg AS (SELECT * FROM (VALUES (true), (false)) a(dry_run), (VALUES (true), (false)) b(apply_labels),
  (VALUES (true), (false)) c(allow_development_writes), (VALUES ('development'), ('transformer')) d(backend)),
w AS (SELECT cfg.*, from_event, CASE
  WHEN NOT dry_run AND backend = 'development' AND NOT allow_development_writes THEN 'blocked_dev'
  WHEN NOT dry_run AND NOT apply_labels THEN 'disabled'
  WHEN status = 'ignored' THEN 'ignored' WHEN status = 'malformed' THEN 'malformed' WHEN dry_run THEN 'dry_run'
  WHEN labels_to_apply = '' THEN 'no_labels' WHEN NOT from_event THEN 'no_event'
  WHEN missing_labels <> '' THEN 'missing_labels' ELSE 'apply' END AS write_status FROM rows, cfg)
SELECT dry_run, apply_labels, allow_development_writes, backend, from_event, write_status,
  CASE WHEN write_status IN ('blocked_dev', 'malformed', 'no_event', 'missing_labels') THEN 1 ELSE 0 END AS exit_code, count(*) AS events
FROM w GROUP BY ALL"""
