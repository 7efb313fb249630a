"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each query reads the driver's tables (through the derived views of
``sources.testdata``) and runs the library operator over all of their rows.
Computed columns carry the same names as in the oracle SQL (``oracles.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.fixed_values import LABEL_CATALOG
from ticketlens.functions import labels as L
from ticketlens.functions.arrays import explode_computed
from ticketlens.functions import text as T
from ticketlens.functions.unicode import nfkc
from ticketlens.operators import postprocess as PP
from ticketlens.operators import scoring as S
from ticketlens.operators import triage as TR
from ticketlens.plans import dataset as P
from ticketlens.plans import triage as PT
from ticketlens.sinks import labels as LS
from ticketlens.sinks.labels import RunConfig
from ticketlens.sources import repo_labels as RL
from ticketlens.sources.catalog import LabelCatalog
from ticketlens.session import bounded_batches, prepare
from ticketlens.sources import testdata as td

LABELS = [label for label, _, _ in LABEL_CATALOG]

# Parameters of the registered dataset build.
CREATED_AFTER = "2024-01-01T00:00:00Z"
CLOSED_BEFORE = "2024-12-01T00:00:00Z"
VALIDATION_FRACTION = 0.15
LOCKBOX_FRACTION = 0.10
FIRST_N = 100

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(prepare(spark))
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return register


# --- text stages (T1..T19) ----------------------------------------------------


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue bodies, issue titles and raw web pages: (src, id, text)."""
    return td.view(spark, sf_dir, td.TEXTS)


def _stage(name: str, step_list: list) -> None:
    @query(name)
    def _q(spark, sf_dir, _steps=step_list):
        t = texts(spark, sf_dir).select("src", "id", "text")
        out = T.apply_steps(t, {"result": T.blank_if_null(F.col("text"))}, _steps)
        return out.select("src", "id", "result")


for _name, _steps in {
    "clean_newlines": [T.normalize_newlines],
    "strip_html_comments": [T.strip_html_comments],
    "strip_command_lines": [T.strip_command_lines],
    "strip_inline_commands": [T.strip_inline_commands],
    "mask_label_mentions": [lambda c: T.mask_label_mentions(c, LABELS)],
    "strip_md_images": [T.strip_md_images],
    "strip_md_links": [T.strip_md_links],
    "strip_html": [T.strip_html],
    "mask_urls": [T.mask_urls],
    "mask_issue_refs": [T.mask_issue_refs],
    "strip_empty_brackets": [T.strip_empty_brackets],
    "strip_control": [T.strip_control],
    "normalize_lines": [T.collapse_blanks, T.strip_lines],
}.items():
    _stage(_name, _steps)


@query("clean_field")
def clean_field(spark, sf_dir):
    """The whole contract (NFKC, T2..T15) over bodies, titles and pages."""
    t = texts(spark, sf_dir).select("src", "id", "text")
    return T.clean_columns(t, {"result": F.col("text")}, LABELS).select("src", "id", "result")


@query("clean_nfkc")
def clean_nfkc(spark, sf_dir):
    """T1 over documents rewritten into compatibility forms (full-width, ligatures, NBSP)."""
    return td.view(spark, sf_dir, td.COMPAT_TEXTS).select("doc_id", nfkc(F.col("text")).alias("result"))


def _cleaned_issues(spark, sf_dir) -> DataFrame:
    iss = td.issues(spark, sf_dir).select("number", "title", "body")
    return P.cleaned_issues(iss, LABELS).select("number", "clean_title", "clean_body", "title_key", "split_group_id")


@query("model_input")
def model_input(spark, sf_dir):
    """T17 from once-cleaned title and body."""
    c = _cleaned_issues(spark, sf_dir)
    return c.select("number", T.model_input(F.col("clean_title"), F.col("clean_body")).alias("model_input"))


@query("title_key")
def title_key(spark, sf_dir):
    return _cleaned_issues(spark, sf_dir).select("number", "title_key")


@query("split_group")
def split_group(spark, sf_dir):
    return _cleaned_issues(spark, sf_dir).select("number", "split_group_id")


# --- dataset build (P1..P3) ------------------------------------------------------


@query("build_rows")
def build_rows(spark, sf_dir):
    """P1 over every issue (labeled or not)."""
    issues = P.with_retained(td.issues(spark, sf_dir), LABELS)
    return P.build_rows(issues, LABELS).drop("created_us")


@query("collect_rows")
def collect_rows(spark, sf_dir):
    """Labeled issues only, as rows."""
    return P.collect_rows(td.issues(spark, sf_dir), LABELS).drop("created_us")


@query("build_dataset")
def build_dataset(spark, sf_dir):
    """Filters, rows, grouped chronological splits."""
    return P.build_dataset(
        td.issues(spark, sf_dir), LABELS, CREATED_AFTER, CLOSED_BEFORE, VALIDATION_FRACTION, LOCKBOX_FRACTION
    )


# --- events, scoring, post-processing, plans (F6, I*, J*, K4-K6, P4) -------------

CATALOG = LabelCatalog.shipped()
LIVE = RunConfig(dry_run=False, apply_labels=True, allow_development_writes=True)
DRY = RunConfig(dry_run=True)


def _joined(col: str) -> F.Column:
    return F.array_join(F.col(col), "|").alias(col)


@query("scan_events")
def scan_events(spark, sf_dir):
    """S2 checks: readable JSON, object, top-level keys."""
    return TR.scan_payloads(td.event_payloads(spark, sf_dir))


@query("event_triage")
def event_triage(spark, sf_dir):
    return TR.triage_events(td.event_payloads(spark, sf_dir))


@query("event_triage_summary")
def event_triage_summary(spark, sf_dir):
    return TR.triage_summary(TR.triage_events(td.event_payloads(spark, sf_dir)))


def repo_label_pages(spark, sf_dir) -> DataFrame:
    """Label-list pages (10 items each, junk items on the first) per repository
    seen in the events."""
    ev = td.table(spark, sf_dir, "events")
    repos = ev.select(
        F.lit("org").alias("owner"),
        F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repo"),
        (F.col("user_id") % 5).alias("r"),
    ).distinct()
    items = repos.select("owner", "repo", "r", F.posexplode(F.array(*[F.lit(x) for x in LABELS])).alias("ord", "label"))
    items = items.where((F.col("ord") + F.col("r")) % 7 != 0)
    pages = items.groupBy("owner", "repo", F.expr("ord div 10").alias("page")).agg(
        F.concat_ws(",", F.collect_list(F.to_json(F.struct(F.col("label").alias("name"))))).alias("items")
    )
    junk = F.when(F.col("page") == 0, F.lit('{"name":5},{"id":1},"x",')).otherwise(F.lit(""))
    return pages.select("owner", "repo", "page", F.concat(F.lit("["), junk, F.col("items"), F.lit("]")).alias("page_text"))


def repo_label_sets(spark, sf_dir) -> DataFrame:
    return RL.label_sets(RL.scan_label_pages(repo_label_pages(spark, sf_dir)), LABELS)


@query("repo_labels")
def repo_labels(spark, sf_dir):
    """Every landed page, items without a string name dropped."""
    return RL.scan_label_pages(repo_label_pages(spark, sf_dir))


def _live_plan(spark, sf_dir) -> DataFrame:
    return PT.triage_issues(td.event_payloads(spark, sf_dir), CATALOG, LIVE, repo_label_sets(spark, sf_dir))


@query("triage_issues")
def triage_issues(spark, sf_dir):
    """Triage, clean, keyword scores, thresholds, repository check, plan."""
    plan = _live_plan(spark, sf_dir)
    return plan.select(
        "event_id", "status", "reason", "owner", "repo", "issue_number", "model_input",
        _joined("labels_to_apply"), _joined("missing_labels"), "write_status", "exit_code", "model_version", "backend",
    )


@query("label_write_plan")
def label_write_plan(spark, sf_dir):
    """K4/K5: what would be written per event, with its exit code."""
    plan = _live_plan(spark, sf_dir)
    return plan.select("event_id", "owner", "repo", "issue_number", _joined("labels_to_apply"), "write_status", "exit_code")


@query("missing_repo_labels")
def missing_repo_labels(spark, sf_dir):
    """Chosen labels the repository does not have."""
    plan = _live_plan(spark, sf_dir)
    return explode_computed(plan, ["event_id", "owner", "repo"], F.col("missing_labels"), "label")


@query("dry_run_report")
def dry_run_report(spark, sf_dir):
    """K6: chosen labels, score rounded to 4 places, threshold."""
    plan = PT.triage_issues(td.event_payloads(spark, sf_dir), CATALOG, DRY)
    return LS.dry_run_report(plan)


@query("score_keywords")
def score_keywords(spark, sf_dir):
    """I1 + I5 over every issue's model input, long form."""
    c = _cleaned_issues(spark, sf_dir)
    texts = c.select("number", T.model_input(F.col("clean_title"), F.col("clean_body")).alias("model_input"))
    scored = S.with_keyword_scores(texts, "model_input", CATALOG)
    return S.stamp(S.explode_predictions(scored, ["number"]), CATALOG, "development")


def folded(col: str, width: int, offset: int = 0):
    """Element i: the sum of all entries j with j = i + offset modulo ``width``."""

    def at(i):
        mine = F.filter(col, lambda _, j: j % width == (i + offset) % width)
        return F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)


def _logits(spark, sf_dir) -> DataFrame:
    """The model's logits in catalog order: all embedding entries, folded onto the catalog's positions."""
    emb = td.logits(spark, sf_dir)
    return emb.select("vec_id", "true_class", folded("embedding", len(LABELS)).alias("logits"))


@query("score_logits")
def score_logits(spark, sf_dir):
    """Sigmoid per position, labelled by catalog order."""
    scored = _logits(spark, sf_dir).select("vec_id", S.logit_scores(F.col("logits"), CATALOG).alias("predictions"))
    out = S.explode_predictions(scored, ["vec_id"])
    return out.withColumn("score", F.round("score", 9))


def raw_prediction_arrays(spark, sf_dir) -> DataFrame:
    """All 64 embedding entries as claimed predictions, one array per vector:
    0-29 catalog labels, 30-59 the same labels all claimed as 'kind'
    (mismatches, and duplicates for kind labels), 60-63 labels the catalog
    does not know."""

    def claim(x, i):
        label = F.when(i < 60, CATALOG.label_at(i % 30)).otherwise(F.concat(F.lit("priority/p"), i.cast("string")))
        taxonomy = F.when(i < 30, L.taxonomy_of(label)).otherwise(F.lit("kind"))
        return F.struct(label.alias("label"), taxonomy.alias("taxonomy"), S.sigmoid(x.cast("double")).alias("score"))

    emb = td.logits(spark, sf_dir)
    return emb.select("vec_id", F.transform("embedding", claim).alias("predictions"))


def raw_predictions(spark, sf_dir) -> DataFrame:
    return S.explode_predictions(raw_prediction_arrays(spark, sf_dir), ["vec_id"])


@query("postprocess")
def postprocess(spark, sf_dir):
    """I4 long form: catalog join, thresholds, selection, catalog order."""
    out = PP.postprocess_long(raw_predictions(spark, sf_dir), CATALOG, spark)
    return out.select("vec_id", "pos", "ord", "label", "taxonomy", F.round("score", 9).alias("score"), "threshold", "selected")


@query("rejected_predictions")
def rejected_predictions(spark, sf_dir):
    """J1 audit: unknown labels and taxonomy mismatches."""
    return PP.rejected_predictions(raw_predictions(spark, sf_dir), CATALOG, spark).select(
        "vec_id", "pos", "label", "taxonomy", "reason")


@query("threshold_predictions")
def threshold_predictions(spark, sf_dir):
    """J2 + F8 on the model's catalog logits: score >= threshold (inclusive)."""
    scored = _logits(spark, sf_dir).select("vec_id", S.logit_scores(F.col("logits"), CATALOG).alias("predictions"))
    post = explode_computed(scored, ["vec_id"], PP.postprocess_array(F.col("predictions"), CATALOG), "p")
    return post.select("vec_id", "p.label", F.round("p.score", 9).alias("score"), "p.threshold", "p.selected")


@query("selected_labels")
def selected_labels(spark, sf_dir):
    """A8 over post-processed raw predictions: distinct chosen labels in catalog order."""
    preds = raw_prediction_arrays(spark, sf_dir)
    post = preds.select("vec_id", PP.selected_labels(PP.postprocess_array(F.col("predictions"), CATALOG)).alias("labels"))
    return post.select("vec_id", _joined("labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
