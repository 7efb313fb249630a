"""Registered queries for the dataset build's parts (S1, S6, F*, A*, T20-T23, G*, K1-K3, O1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import labels as L
from ticketlens.functions import parsing as PR
from ticketlens.functions import tokens as TK
from ticketlens.operators import filters as FL
from ticketlens.operators import splits as SP
from ticketlens.plans import dataset as P
from ticketlens.queries import (
    CLOSED_BEFORE,
    CREATED_AFTER,
    FIRST_N,
    LABELS,
    LOCKBOX_FRACTION,
    VALIDATION_FRACTION,
    query,
)
from ticketlens.session import scratch_path
from ticketlens.sinks import dataset as K
from ticketlens.sources import catalog as C
from ticketlens.sources import issues as SI
from ticketlens.sources import landing as LD
from ticketlens.sources import testdata as td

MAX_LENGTH = 64  # token budget of the registered truncation query
SPECIALS = ("[CLS]", "[SEP]")
PAD = "[PAD]"
BATCH = 8


def _issues(spark, sf_dir) -> DataFrame:
    return td.issues(spark, sf_dir)


# --- S1: landed issue pages -------------------------------------------------------


def issue_pages(spark, sf_dir) -> DataFrame:
    """Issues landed as API pages of up to 100 JSON objects (page = number div 100).

    Some items are damaged the way untyped JSON can be: a string number
    (number % 23 = 0), a numeric title (% 29 = 0), a numeric body (% 31 = 0), a
    naive created_at (% 19 = 0);
    every page also ends with two non-object items.
    """
    iss = _issues(spark, sf_dir)
    obj = F.struct(
        "number", "title", "body", "created_at", "closed_at", "html_url",
        F.transform("labels", lambda x: F.struct(x.alias("name"))).alias("labels"),
    )
    js = F.to_json(obj)
    js = F.when(F.col("is_pull_request"), F.regexp_replace(js, r"\}$", ',"pull_request":{}}')).otherwise(js)
    js = F.when(F.col("number") % 23 == 0, F.regexp_replace(js, r'^\{"number":(\d+)', '{"number":"$1"')).otherwise(js)
    js = F.when(F.col("number") % 29 == 0, F.regexp_replace(js, r'"title":"(?:[^"\\]|\\.)*+"', '"title":7')).otherwise(js)
    js = F.when(F.col("number") % 31 == 0, F.regexp_replace(js, r'"body":"(?:[^"\\]|\\.)*+"', '"body":7')).otherwise(js)
    js = F.when(F.col("number") % 19 == 0, F.regexp_replace(js, r'("created_at":"[^"]*)Z"', '$1"')).otherwise(js)
    items = iss.select(F.expr("number div 100").alias("page"), "number", js.alias("item"))
    pages = items.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("number", "item"))).alias("items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit(',42,"x"]'))
    return pages.select("page", text.alias("page_text"))


def scanned_issues(spark, sf_dir) -> DataFrame:
    return SI.scan_issue_pages(issue_pages(spark, sf_dir), keep=("page",))


@query("scan_issues")
def scan_issues(spark, sf_dir):
    """Objects of every page, typed by JSON type (no coercion)."""
    s = scanned_issues(spark, sf_dir)
    return s.select("page", "item_pos", *SI.ISSUE_COLUMNS[:-2],
                    F.array_join("labels", "|", "~").alias("labels"), "is_pull_request")


@query("invalid_issues")
def invalid_issues(spark, sf_dir):
    """scanned items no dataset row can be built from, with the first reason."""
    return FL.invalid_issues(scanned_issues(spark, sf_dir)).select("page", "item_pos", "reason")


def _build_from_pages(spark, sf_dir) -> P.Build:
    return P.build(scanned_issues(spark, sf_dir), LABELS, CREATED_AFTER, CLOSED_BEFORE, VALIDATION_FRACTION, LOCKBOX_FRACTION)


@query("build_dataset_from_pages")
def build_dataset_from_pages(spark, sf_dir):
    """P3 end to end: damaged pages -> scan -> outcomes -> rows -> splits -> written dataset, read back."""
    built = _build_from_pages(spark, sf_dir)
    return K.read_dataset(spark, K.write_dataset(built.rows, scratch_path(spark, "dataset-from-pages")))


@query("build_quarantine")
def build_quarantine(spark, sf_dir):
    """F7 in the build: the issues of the window that cannot become rows, with the reason."""
    return _build_from_pages(spark, sf_dir).quarantine.select("page", "item_pos", "reason")


@query("build_outcomes")
def build_outcomes(spark, sf_dir):
    """Every scanned issue counted under exactly one outcome of the build."""
    return _build_from_pages(spark, sf_dir).outcomes


@query("issue_lookup")
def issue_lookup(spark, sf_dir):
    """Issues named by owner/repo#number references carried by the events."""
    iss = _issues(spark, sf_dir).withColumn("owner", F.lit("kubernetes")).withColumn("repo", F.lit("kubernetes"))
    ev = td.table(spark, sf_dir, "events")
    wanted = ev.select(F.concat(F.lit("kubernetes/kubernetes#"), (F.col("event_id") * 7 % 1500).cast("string")).alias("ref"))
    parsed = wanted.select(PR.parse_issue_reference(F.col("ref")).alias("r")).select("r.*").distinct()
    return SI.issue_lookup(iss, parsed).select("number", "title", "body")


# --- filters ----------------------------------------------------------------------


@query("filter_pull_requests")
def filter_pull_requests(spark, sf_dir):
    return FL.filter_pull_requests(_issues(spark, sf_dir)).select("number")


@query("filter_date_window")
def filter_date_window(spark, sf_dir):
    return FL.filter_date_window(_issues(spark, sf_dir), CREATED_AFTER, CLOSED_BEFORE).select("number")


# A window in the middle of the landed days, with offsets on both ends.
DAY_WINDOW = ("2024-03-01T01:00:00+02:00", "2024-05-31T20:00:00-03:00")


def _landed(spark, sf_dir) -> str:
    return LD.land_issues(_issues(spark, sf_dir), scratch_path(spark, "landed-issues"))


@query("filter_date_window_landed")
def filter_date_window_landed(spark, sf_dir):
    """F3 over issues landed by day: only the days of the window are read."""
    return FL.filter_date_window(LD.read_landed(spark, _landed(spark, sf_dir)), *DAY_WINDOW).select("number", "created_at")


@query("stream_landed_window")
def stream_landed_window(spark, sf_dir):
    """F2/F3 as a stream over the landed days: each file once, the same window."""
    path = _landed(spark, sf_dir)
    issues = LD.stream_landed(spark, path, LD.read_landed(spark, path).schema)
    sink = scratch_path(spark, "landed-sink")
    done = FL.filter_date_window(issues, *DAY_WINDOW).select("number", "created_at").writeStream.format("parquet").option(
        "checkpointLocation", scratch_path(spark, "landed-ckpt")).trigger(availableNow=True).start(sink)
    done.awaitTermination()
    return spark.read.schema("number bigint, created_at string").parquet(sink)


@query("filter_labeled")
def filter_labeled(spark, sf_dir):
    return FL.filter_labeled(P.with_retained(_issues(spark, sf_dir), LABELS)).select("number")


@query("first_n_issues")
def first_n_issues(spark, sf_dir):
    """The first 100 labeled issues in scan order (the limit is the feature)."""
    kept = FL.filter_labeled(P.with_retained(_issues(spark, sf_dir), LABELS))
    kept = kept.withColumn("created_us", PR.unix_micros(F.col("created_at")))
    return FL.first_n(kept, FIRST_N).select("number", "created_at")


@query("ordered_dataset")
def ordered_dataset(spark, sf_dir):
    """O1: rows in (creation string, number) order."""
    rows = P.collect_rows(_issues(spark, sf_dir), LABELS, ordered=True)
    return rows.select("sample_id", "issue_created_at", "issue_number")


# --- labels and text helpers --------------------------------------------------------


@query("retained_labels")
def retained_labels(spark, sf_dir):
    iss = P.with_retained(_issues(spark, sf_dir), LABELS)
    return iss.select("number", F.array_join("retained", "|").alias("retained_labels"))


@query("retained_labels_semi")
def retained_labels_semi(spark, sf_dir):
    """The same set as A1 by exploding raw names and semi-joining the catalog."""
    cat = C.LabelCatalog.shipped().dataframe(spark).select("label")
    raw = _issues(spark, sf_dir).select("number", F.explode(F.array_distinct("labels")).alias("label"))
    return raw.join(F.broadcast(cat), "label", "left_semi").select("number", "label")


@query("taxonomy_labels")
def taxonomy_labels(spark, sf_dir):
    """A2 + A3."""
    iss = P.with_retained(_issues(spark, sf_dir), LABELS)
    r = F.col("retained")
    return iss.select(
        "number",
        L.labels_with_prefix(r, "kind/").alias("kind_labels"),
        L.labels_with_prefix(r, "sig/").alias("sig_labels"),
        L.labels_with_prefix(r, "area/").alias("area_labels"),
        F.size(r).alias("retained_label_count"),
    )


@query("label_targets")
def label_targets(spark, sf_dir):
    """A4: one 0/1 column per catalog label, in one projection."""
    iss = P.with_retained(_issues(spark, sf_dir), LABELS)
    return iss.select("number", *L.multi_hot(F.col("retained"), LABELS))


@query("label_frequency")
def label_frequency(spark, sf_dir):
    """A4 long form: issues per catalog label (zeros kept), with target column names."""
    iss = P.with_retained(_issues(spark, sf_dir), LABELS)
    counts = iss.select(F.explode("retained").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("issues"))
    cat = C.LabelCatalog.shipped().dataframe(spark)
    out = F.broadcast(cat).join(counts, "label", "left")
    return out.select("ord", "label", "taxonomy", "threshold", L.target_column_expr(F.col("label")).alias("target_column"),
                      F.coalesce("issues", F.lit(0)).alias("issues"))


@query("target_names")
def target_names(spark, sf_dir):
    """T20 over every distinct raw label name seen on issues."""
    raw = _issues(spark, sf_dir).select(F.explode("labels").alias("label")).where(F.col("label").isNotNull()).distinct()
    return raw.select("label", L.target_column_expr(F.col("label")).alias("target_column"))


@query("catalog_violations")
def catalog_violations(spark, sf_dir):
    """S4 rules over a label schema proposed from the labels seen on issues."""
    raw = _issues(spark, sf_dir).select(F.explode("labels").alias("label"))
    return C.label_rule_violations(raw).select("label", "rule")


@query("parse_ts")
def parse_ts(spark, sf_dir):
    """Zoned ISO text to an instant; naive text refused (NULL)."""
    iss = _issues(spark, sf_dir)
    raw = (
        F.when(F.col("number") % 4 == 1, F.regexp_replace("created_at", "Z$", "+02:00"))
        .when(F.col("number") % 4 == 2, F.regexp_replace("created_at", "Z$", ""))
        .when(F.col("number") % 16 == 3, F.regexp_replace("created_at", "Z$", "+02"))
        .when(F.col("number") % 16 == 7, F.regexp_replace("created_at", "Z$", "+02:00:30"))
        .when(F.col("number") % 16 == 11, F.regexp_replace("created_at", "[-:]", ""))
        .when(F.col("number") % 4 == 3, F.regexp_replace("created_at", "Z$", ".1234567-0530"))
        .otherwise(F.col("created_at"))
    )
    t = iss.select("number", raw.alias("raw"))
    return t.select("number", "raw", PR.unix_micros(F.col("raw")).alias("created_us"))


@query("issue_identity")
def issue_identity(spark, sf_dir):
    """Sample id, and the issue URL (or a built default)."""
    iss = _issues(spark, sf_dir)
    return iss.select(
        "number",
        PR.sample_id(F.col("number")).alias("sample_id"),
        PR.issue_url(F.col("html_url"), F.col("number"), "kubernetes/kubernetes").alias("issue_url"),
    )


@query("parse_issue_refs")
def parse_issue_refs(spark, sf_dir):
    """owner/repo#number references (valid, padded, and broken forms)."""
    ev = td.table(spark, sf_dir, "events")
    base = F.concat(F.lit("org/repo"), (F.col("user_id") % 5).cast("string"))
    num = F.col("event_id").cast("string")
    k = F.col("event_id") % 6
    ref = (
        F.when(k == 0, F.concat(base, F.lit("#"), num))
        .when(k == 1, F.concat(F.lit("  "), base, F.lit("#"), num, F.lit(" ")))
        .when(k == 2, F.concat(base, num))
        .when(k == 3, F.concat(base, F.lit("#99999999999999999999")))  # beyond BIGINT
        .when(k == 4, F.concat(base, F.lit("#"), F.translate(num, "0123456789", "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669")))
        .otherwise(F.concat(F.lit("org repo#"), num))
    )
    t = ev.select("event_id", ref.alias("ref"))
    return t.select("event_id", "ref", PR.parse_issue_reference(F.col("ref")).alias("r")).select(
        "event_id", "ref", "r.owner", "r.repo", "r.number")


# --- tokens -------------------------------------------------------------------------


def _encoded(spark, sf_dir) -> DataFrame:
    toks = td.tokens(spark, sf_dir)
    cut = TK.head_tail(F.col("tokens"), MAX_LENGTH, len(SPECIALS))
    return toks.select("doc_id", F.size("tokens").alias("n_tokens"), TK.with_specials(cut, *SPECIALS).alias("ids"))


@query("head_tail_tokens")
def head_tail_tokens(spark, sf_dir):
    """A5 + A6: head/tail truncation of whole-document tokens, specials, mask."""
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", "n_tokens", F.size("ids").alias("n_ids"), F.array_join("ids", " ").alias("ids"),
                    F.aggregate(TK.attention_mask(F.col("ids")), F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("pad_batches")
def pad_batches(spark, sf_dir):
    """Pad to the batch's longest row, rounded up to a multiple of 8."""
    e = _encoded(spark, sf_dir).withColumn("batch_id", F.expr(f"doc_id div {BATCH}"))
    padded = TK.pad_batches(e, "batch_id", "ids", PAD)
    return padded.select("doc_id", "batch_id", F.size("ids").alias("n_ids"), "padded_length", "n_pad",
                         F.size("input_ids").alias("n_input_ids"),
                         F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


# --- splits ---------------------------------------------------------------------------


def _rows(spark, sf_dir) -> DataFrame:
    return P.collect_rows(_issues(spark, sf_dir), LABELS)


@query("split_cutoffs")
def split_cutoffs(spark, sf_dir):
    """G1: exact interpolated cut instants over the labeled rows."""
    fr = SP.cut_fractions(VALIDATION_FRACTION, LOCKBOX_FRACTION)
    return SP.split_cutoffs(_rows(spark, sf_dir), "created_us", fr)


@query("group_latest")
def group_latest(spark, sf_dir):
    """Newest creation instant and size of each split group."""
    rows = _rows(spark, sf_dir)
    groups = SP.group_latest(rows, "split_group_id", "created_us")
    return groups.select("split_group_id", "group_latest_us", F.col("group_rows").alias("rows"))


@query("assign_splits")
def assign_splits(spark, sf_dir):
    """G3 over all labeled rows (no date window)."""
    out = SP.assign_splits(_rows(spark, sf_dir), VALIDATION_FRACTION, LOCKBOX_FRACTION)
    return out.select("sample_id", "split_group_id", "final_split")


def _dataset(spark, sf_dir) -> DataFrame:
    return P.build_dataset(_issues(spark, sf_dir), LABELS, CREATED_AFTER, CLOSED_BEFORE,
                           VALIDATION_FRACTION, LOCKBOX_FRACTION)


@query("split_leakage")
def split_leakage(spark, sf_dir):
    """Groups found in more than one split (empty)."""
    return SP.split_leakage(_dataset(spark, sf_dir))


@query("label_leakage")
def label_leakage(spark, sf_dir):
    """Model inputs that still mention a catalog label or hold a command line (empty)."""
    from ticketlens.functions import text as T

    ds = _dataset(spark, sf_dir)
    leaked = F.col("model_input").rlike(T.label_mention_pattern(LABELS)) | F.col("model_input").rlike(T.COMMAND_LINE)
    return ds.where(leaked).select("sample_id")


@query("split_manifest")
def split_manifest(spark, sf_dir):
    """The run's parameters, and rows, distinct groups and digest of each of the three splits."""
    path = K.write_dataset(_dataset(spark, sf_dir), scratch_path(spark, "manifest-dataset"))
    return K.split_manifest(K.read_dataset(spark, path), P.dataset_columns(LABELS)[:-1], LABELS, CREATED_AFTER, CLOSED_BEFORE,
                            VALIDATION_FRACTION, LOCKBOX_FRACTION)


@query("split_digest")
def split_digest(spark, sf_dir):
    """K3: order-free content digest per split."""
    ds = _dataset(spark, sf_dir)
    return K.split_digest(ds, P.dataset_columns(LABELS)[:-1])


@query("dataset_roundtrip")
def dataset_roundtrip(spark, sf_dir):
    """K1: write partitioned by split under the shared checkpoint folder, read back."""
    path = K.write_dataset(_dataset(spark, sf_dir), scratch_path(spark, "dataset"))
    return K.read_dataset(spark, path)
