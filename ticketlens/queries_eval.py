"""Registered queries: evaluation (E1-E6), batch scorer (I3), streaming (ST1, ST2)."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import labels as L
from ticketlens.functions.arrays import explode_computed
from ticketlens.functions import text as T
from ticketlens.operators import baseline as B
from ticketlens.operators import evaluate as E
from ticketlens.operators import postprocess as PP
from ticketlens.operators import scoring as S
from ticketlens.plans import dataset as P
from ticketlens.queries import CATALOG, DRY, LABELS, LIVE, _cleaned_issues, _logits, folded, query, repo_label_sets
from ticketlens.queries import CLOSED_BEFORE, CREATED_AFTER, LOCKBOX_FRACTION, VALIDATION_FRACTION
from ticketlens.session import scratch_path
from ticketlens.operators.triage import triage_events
from ticketlens.plans.triage import score_events
from ticketlens.sinks import dataset as K
from ticketlens.sinks.labels import RunConfig, label_write_plan
from ticketlens.sources import catalog as C
from ticketlens.sources import testdata as td
from ticketlens.streaming import triage as ST

# (model, seed, rotation of the folded embedding that makes its 30 logits)
RUNS = (
    ("model_a", 7, 0), ("model_a", 42, 1), ("model_a", 123, 2),
    ("model_b", 7, 32), ("model_b", 42, 33), ("model_b", 123, 34),
    ("baseline", 0, 17),
)
BASELINE_MODEL = "baseline"


def truth_pairs(spark, sf_dir) -> DataFrame:
    """True labels per vector: the class's label and one derived label."""
    emb = td.logits(spark, sf_dir)
    ords = F.array(F.col("true_class"), (F.col("true_class") * 3 + 1) % 30)
    return emb.select("vec_id", F.explode(ords).alias("ord")).select("vec_id", CATALOG.label_at(F.col("ord")).alias("label"))


def _postprocessed(spark, sf_dir) -> DataFrame:
    scored = _logits(spark, sf_dir).select("vec_id", S.logit_scores(F.col("logits"), CATALOG).alias("predictions"))
    return scored.select("vec_id", PP.postprocess_array(F.col("predictions"), CATALOG).alias("post"))


def predicted_pairs(spark, sf_dir) -> DataFrame:
    post = _postprocessed(spark, sf_dir)
    return explode_computed(post, ["vec_id"], PP.selected_labels(F.col("post")), "label")


def _flags(spark, sf_dir) -> DataFrame:
    return E.pair_flags(truth_pairs(spark, sf_dir), predicted_pairs(spark, sf_dir), ["vec_id"])


def _r9(df: DataFrame, cols=("precision", "recall", "f1")) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


@query("eval_micro")
def eval_micro(spark, sf_dir):
    """Micro precision / recall / F1 over (item, label) pairs."""
    return _r9(E.micro(_flags(spark, sf_dir)))


def _per_label(spark, sf_dir) -> DataFrame:
    return E.per_label(_flags(spark, sf_dir), CATALOG.dataframe(spark))


@query("eval_per_label")
def eval_per_label(spark, sf_dir):
    """Counts and F1 for every catalog label (zero support -> F1 0)."""
    return _r9(_per_label(spark, sf_dir))


@query("eval_macro")
def eval_macro(spark, sf_dir):
    """Mean per-label F1 over all catalog labels."""
    return _r9(E.macro(_per_label(spark, sf_dir)), ("macro_f1",))


@query("eval_exact_match")
def eval_exact_match(spark, sf_dir):
    """Share of items whose predicted set equals the true set."""
    items = td.logits(spark, sf_dir).select("vec_id")
    return _r9(E.exact_match(_flags(spark, sf_dir), items, "vec_id"), ("exact_match",))


def _sweep(spark, sf_dir) -> DataFrame:
    scored = _logits(spark, sf_dir).select("vec_id", S.logit_scores(F.col("logits"), CATALOG).alias("predictions"))
    return E.threshold_sweep(scored, truth_pairs(spark, sf_dir), ["vec_id"])


@query("threshold_sweep")
def threshold_sweep(spark, sf_dir):
    """Micro P/R/F1 per taxonomy at every threshold of the 0.025 grid."""
    return _r9(_sweep(spark, sf_dir))


@query("best_thresholds")
def best_thresholds(spark, sf_dir):
    """The per-taxonomy threshold with the best F1 (ties: lower threshold)."""
    return _r9(E.best_thresholds(_sweep(spark, sf_dir)))


def _logit_pairs(spark, sf_dir) -> DataFrame:
    """(taxonomy, score, is_true) of every item and catalog label, scored by the logit (its order is the score's)."""
    ords = F.array(F.col("true_class"), (F.col("true_class") * 3 + 1) % 30)
    pairs = _logits(spark, sf_dir).select(ords.alias("ords"), F.posexplode("logits").alias("ord", "score"))
    return pairs.select(
        F.split_part(CATALOG.label_at(F.col("ord")), F.lit("/"), F.lit(1)).alias("taxonomy"), "score",
        F.array_contains("ords", F.col("ord")).cast("int").alias("is_true"))


@query("exact_threshold_sweep")
def exact_threshold_sweep(spark, sf_dir):
    """E4, exact: micro P/R/F1 per taxonomy at every distinct logit."""
    return _r9(E.exact_sweep(_logit_pairs(spark, sf_dir)))


@query("best_exact_thresholds")
def best_exact_thresholds(spark, sf_dir):
    """E4, exact: the logit with the best F1 per taxonomy (ties: the lower one)."""
    return _r9(E.best_exact(E.exact_sweep(_logit_pairs(spark, sf_dir))))


def _validation_sweep(spark, sf_dir) -> DataFrame:
    rows = P.build_dataset(td.issues(spark, sf_dir), LABELS, CREATED_AFTER, CLOSED_BEFORE, VALIDATION_FRACTION, LOCKBOX_FRACTION)
    validation = rows.where(F.col("final_split") == "validation").select("sample_id", "model_input", "retained_labels")
    scored = S.with_keyword_scores(validation, "model_input", CATALOG)
    truth = validation.select("sample_id", F.explode(F.split("retained_labels", r"\|")).alias("label"))
    return E.threshold_sweep(scored.select("sample_id", "predictions"), truth, ["sample_id"])


@query("validation_sweep")
def validation_sweep(spark, sf_dir):
    """E4 as it is meant to be used: the sweep over the dataset's validation split only."""
    return _r9(_validation_sweep(spark, sf_dir))


def run_metrics(spark, sf_dir) -> DataFrame:
    """Micro-F1 of every (model, seed) run against the same truth."""
    emb = td.logits(spark, sf_dir)
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"),
                              folded("embedding", len(LABELS), o).alias("logits")) for m, s, o in RUNS])
    per_run = emb.select("vec_id", "true_class", F.explode(runs).alias("run")).select(
        "vec_id", "true_class", "run.model", "run.seed", "run.logits")
    post = per_run.select("vec_id", "true_class", "model", "seed", PP.selected_labels(
        PP.postprocess_array(S.logit_scores(F.col("logits"), CATALOG), CATALOG)).alias("chosen"))
    pred = explode_computed(post, ["model", "seed", "vec_id"], F.col("chosen"), "label")
    ords = F.array(F.col("true_class"), (F.col("true_class") * 3 + 1) % 30)
    truth = post.select("model", "seed", "vec_id", F.explode(ords).alias("ord")).select(
        "model", "seed", "vec_id", CATALOG.label_at(F.col("ord")).alias("label"))
    flags = E.pair_flags(truth, pred, ["model", "seed", "vec_id"])
    return E.micro(flags, ["model", "seed"])


@query("seed_comparison")
def seed_comparison(spark, sf_dir):
    """E5: mean micro-F1 over seeds, seeds won, gap to the baseline run."""
    out = E.seed_comparison(run_metrics(spark, sf_dir), BASELINE_MODEL, "f1")
    return _r9(out, ("mean_metric", "delta_to_baseline"))


@query("label_catalog")
def label_catalog(spark, sf_dir):
    """S3: per-taxonomy thresholds chosen on the data (E4), written as a model
    bundle under the shared folder, loaded back through the validated loader."""
    best = E.best_thresholds(_sweep(spark, sf_dir)).select("taxonomy", "threshold")
    chosen = {r["taxonomy"]: r["threshold"] for r in best.collect()}  # one row per taxonomy
    tuned = C.LabelCatalog.with_thresholds(LABELS, {lab: chosen[lab.split("/", 1)[0]] for lab in LABELS})
    path = C.write_bundle(spark, scratch_path(spark, "bundle"), tuned)
    return C.load_artifacts(spark, path, backend=tuned.backend).dataframe(spark)


@query("bundle_violations")
def bundle_violations(spark, sf_dir):
    """The rules a broken bundle fails, for bundles made from the data-tuned one by one change each."""
    best = E.best_thresholds(_sweep(spark, sf_dir)).select("taxonomy", "threshold")
    chosen = {r["taxonomy"]: r["threshold"] for r in best.collect()}  # one row per taxonomy
    tuned = C.LabelCatalog.with_thresholds(LABELS, {lab: chosen[lab.split("/", 1)[0]] for lab in LABELS})
    first = LABELS[0]

    def broken(change):
        files = json.loads(json.dumps(C.bundle_payloads(tuned)))
        change(files["m"], files["s"], files["t"])
        return [json.dumps(files[k]) for k in ("m", "s", "t")]

    cases = {
        "valid": lambda m, s, t: None,
        "text_threshold": lambda m, s, t: t["values"].update({first: "0.5"}),
        "threshold_above_one": lambda m, s, t: t["values"].update({first: 1.5}),
        "threshold_missing": lambda m, s, t: t["values"].pop(first),
        "plain_thresholds": lambda m, s, t: (t.update(t.pop("values")), t.pop("strategy")),
        "number_label": lambda m, s, t: m["labels"].__setitem__(0, 7),
        "label_twice": lambda m, s, t: m["labels"].append(first),
        "other_order": lambda m, s, t: m["labels"].reverse(),
        "number_taxonomy": lambda m, s, t: s["labels"][0].update(taxonomy=1),
        "wrong_taxonomy": lambda m, s, t: s["labels"][0].update(taxonomy="kind"),
        "short_input": lambda m, s, t: m.update(max_length=4),
        "text_length": lambda m, s, t: m.update(max_length="512"),
        "no_version": lambda m, s, t: m.update(model_version=""),
        "old_contract": lambda m, s, t: m.update(preprocessing_version="old"),
    }
    rows = [(name, *broken(change)) for name, change in cases.items()]
    raw = spark.createDataFrame(rows, "bundle string, m string, s string, t string")
    return C.bundle_checks(raw.select("bundle", *[F.parse_json(c).alias(c) for c in ("m", "s", "t")]))


# --- E6: TF-IDF baseline (rows-only checks) ---------------------------------------------------


def _dataset(spark, sf_dir) -> DataFrame:
    """The dataset, written once and read by every step of the baseline."""
    rows = P.build_dataset(td.issues(spark, sf_dir), LABELS, CREATED_AFTER, CLOSED_BEFORE,
                           VALIDATION_FRACTION, LOCKBOX_FRACTION)
    return K.read_dataset(spark, K.write_dataset(rows, scratch_path(spark, "baseline-dataset")))


@query("tfidf_features")
def tfidf_features(spark, sf_dir):
    """E6 features: sparse TF-IDF (sample, term, weight) of every dataset row, IDF from the train split."""
    ds = _dataset(spark, sf_dir)
    out = B.sparse_tfidf(ds, ds.where(F.col("final_split") == "train"))
    return out.withColumn("weight", F.round("weight", 9))


def _baseline(ds: DataFrame) -> B.LinearModel:
    return B.fit(ds.where(F.col("final_split") == "train"), L.target_columns(LABELS), LABELS)


@query("tfidf_lr_scores")
def tfidf_lr_scores(spark, sf_dir):
    """Per-label logistic regression on TF-IDF, fitted on the whole train split, scoring every row."""
    ds = _dataset(spark, sf_dir)
    return B.score_labels(ds, _baseline(ds), ["sample_id", "final_split"])


# --- I3: batch scorer ---------------------------------------------------------------------------


@query("score_batch")
def score_batch(spark, sf_dir):
    """The development scorer plugged in by name, Arrow batches via mapInPandas."""
    c = _cleaned_issues(spark, sf_dir)
    texts = c.select("number", T.model_input(F.col("clean_title"), F.col("clean_body")).alias("model_input"))
    scorer = S.create_scorer("development", CATALOG)
    scored = S.score_batch(texts, "model_input", ["number"], CATALOG, scorer)
    return S.stamp(S.explode_predictions(scored, ["number"]), CATALOG, "development")


@query("score_batch_linear")
def score_batch_linear(spark, sf_dir):
    """A loaded model plugged in by name - the fitted baseline scores the cleaned text of every dataset row."""
    ds = _dataset(spark, sf_dir)
    scorer = S.create_scorer("linear", CATALOG, model=S.shared_model(spark, _baseline(ds)))
    scored = S.score_batch(ds, "model_input", ["sample_id"], CATALOG, scorer)
    return S.stamp(S.explode_predictions(scored, ["sample_id"]), CATALOG, "linear")


# --- ST1 / ST2: streaming -------------------------------------------------------------------------


def _land(spark, sf_dir) -> str:
    return ST.land_envelopes(td.event_payloads(spark, sf_dir), scratch_path(spark, "landing"))


@query("stream_triage")
def stream_triage(spark, sf_dir):
    """ST1: the triage plan as a stream (availableNow), read back from its sink."""
    landing = _land(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "triage-sink"), scratch_path(spark, "triage-ckpt")
    q = ST.start_triage_stream(spark, landing, sink, ckpt, CATALOG, LIVE, repo_label_sets(spark, sf_dir))
    q.awaitTermination()
    return spark.read.parquet(sink)


@query("stream_event_files")
def stream_event_files(spark, sf_dir):
    """S2 as a stream: one payload file per benchmark item, triaged in dry-run mode."""
    landing, sink = scratch_path(spark, "payload-files"), scratch_path(spark, "files-sink")
    item = td.table(spark, sf_dir, "benchmark")
    payload = F.to_json(F.struct(
        F.lit("opened").alias("action"),
        F.struct(F.col("item_id").alias("number"), F.concat(F.lit("kubelet bug "), F.col("item_id")).alias("title"),
                 F.col("text").alias("body"), F.concat(F.lit("https://example.test/"), F.col("item_id")).alias("html_url"),
                 F.struct(F.lit("User").alias("type")).alias("user")).alias("issue"),
        F.struct(F.lit("r").alias("name"), F.struct(F.lit("o").alias("login")).alias("owner")).alias("repository"),
    ))
    item.select(payload.alias("value")).write.option("maxRecordsPerFile", 1).text(landing)
    ST.start_file_triage_stream(spark, landing, sink, scratch_path(spark, "files-ckpt"), CATALOG, DRY).awaitTermination()
    return spark.read.parquet(sink).select("issue_number", "status", "model_input", "labels_to_apply", "write_status")


# (dry_run, apply_labels, allow_development_writes, backend): every configuration
GATE_CONFIGS = tuple(itertools.product((True, False), (True, False), (True, False), ("development", "transformer")))


@query("write_gates")
def write_gates(spark, sf_dir):
    """K5: what each run configuration does with the events, and with the same titles and bodies given without an event."""
    triaged = score_events(triage_events(td.event_payloads(spark, sf_dir), "payload"), CATALOG)
    checked = PP.missing_repo_labels(triaged, repo_label_sets(spark, sf_dir), CATALOG)
    slim = checked.select("status", "owner", "labels_to_apply", "missing_labels", F.lit(True).alias("from_event"))
    path = scratch_path(spark, "gate-events")
    slim.write.parquet(path)
    events = spark.read.parquet(path)
    bare = events.where(F.col("status") == "accepted").withColumns({"owner": F.lit(None).cast("string"), "from_event": F.lit(False)})
    rows = events.unionByName(bare)
    out = None
    for dry, apply, allow, backend in GATE_CONFIGS:
        plan = label_write_plan(rows, RunConfig(dry, apply, allow, backend))
        counted = plan.groupBy("from_event", "write_status", "exit_code").agg(F.count(F.lit(1)).alias("events")).select(
            F.lit(dry).alias("dry_run"), F.lit(apply).alias("apply_labels"), F.lit(allow).alias("allow_development_writes"),
            F.lit(backend).alias("backend"), "*")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("stream_replay")
def stream_replay(spark, sf_dir):
    """ST2: run the label-application stream twice over the same events; the
    second run (fresh checkpoint, a full replay) must add nothing."""
    landing = _land(spark, sf_dir)
    applied = scratch_path(spark, "applied")
    for attempt in ("first", "replay"):
        ckpt = scratch_path(spark, f"apply-ckpt-{attempt}")
        q = ST.start_apply_stream(spark, landing, applied, ckpt, CATALOG, LIVE, repo_label_sets(spark, sf_dir))
        q.awaitTermination()
    return spark.read.parquet(applied).drop("bucket")
