"""Post-processing of predictions.

Two shapes of the same contract:

* per issue, on the ``predictions`` array: catalog membership, taxonomy check,
  threshold and order are map lookups on the catalog inlined as literals -- no
  join, no shuffle;
* long form, a table of predictions: a join with the catalog DataFrame (driver
  configuration), plus the rejected rows for audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.labels import distinct_selected
from ticketlens.sources.catalog import LabelCatalog

POSTPROCESSED_TYPE = (
    "array<struct<ord:int,pos:int,label:string,taxonomy:string,score:double,threshold:double,selected:boolean>>"
)


def postprocess_array(predictions: Column, catalog: LabelCatalog) -> Column:
    """Keep known labels whose claimed taxonomy matches, add threshold and
    ``selected = score >= threshold``, order by catalog position (stable)."""
    tax_map = {lab: tax for lab, tax in zip(catalog.labels, catalog.taxonomies)}
    pairs = []
    for lab, tax in tax_map.items():
        pairs += [F.lit(lab), F.lit(tax)]
    taxonomy_of = F.create_map(*pairs)
    thr_pairs, ord_pairs = [], []
    for i, (lab, thr) in enumerate(zip(catalog.labels, catalog.thresholds)):
        thr_pairs += [F.lit(lab), F.lit(float(thr))]
        ord_pairs += [F.lit(lab), F.lit(i)]
    threshold_of, ord_of = F.create_map(*thr_pairs), F.create_map(*ord_pairs)

    positioned = F.transform(predictions, lambda p, i: F.struct(p.alias("p"), i.alias("pos")))
    kept = F.filter(positioned, lambda x: F.try_element_at(taxonomy_of, x["p"]["label"]) == x["p"]["taxonomy"])
    enriched = F.transform(
        kept,
        lambda x: F.struct(
            F.try_element_at(ord_of, x["p"]["label"]).alias("ord"),
            x["pos"].alias("pos"),
            x["p"]["label"].alias("label"),
            x["p"]["taxonomy"].alias("taxonomy"),
            x["p"]["score"].alias("score"),
            F.try_element_at(threshold_of, x["p"]["label"]).alias("threshold"),
            (x["p"]["score"] >= F.try_element_at(threshold_of, x["p"]["label"])).alias("selected"),
        ),
    )
    return F.array_sort(enriched)  # (ord, pos) first: catalog order, stable


def postprocess_aligned(predictions: Column, catalog: LabelCatalog) -> Column:
    """``postprocess_array`` for scorer output already aligned with the catalog
    (element i is catalog label i with its own taxonomy, as the keyword and
    logit scorers produce): every element is kept and already in catalog
    order, so only the threshold is attached -- one positional pass, no map
    lookups, no sort. Same result as ``postprocess_array`` on such input."""
    thresholds = F.array(*[F.lit(float(t)) for t in catalog.thresholds])
    return F.transform(
        predictions,
        lambda p, i: F.struct(
            i.alias("ord"),
            i.alias("pos"),
            p["label"].alias("label"),
            p["taxonomy"].alias("taxonomy"),
            p["score"].alias("score"),
            F.element_at(thresholds, i + 1).alias("threshold"),
            (p["score"] >= F.element_at(thresholds, i + 1)).alias("selected"),
        ),
    )


def selected_labels(postprocessed: Column) -> Column:  # A8
    return distinct_selected(postprocessed)


# --- long form -------------------------------------------------------------------


def join_catalog(predictions: DataFrame, catalog: LabelCatalog, spark: SparkSession) -> DataFrame:
    """Predictions (id..., label, taxonomy, score) with catalog columns; left join on label."""
    cat = catalog.dataframe(spark).select(
        "ord", "label", F.col("taxonomy").alias("catalog_taxonomy"), "threshold"
    )
    return predictions.join(F.broadcast(cat), "label", "left")


def postprocess_long(predictions: DataFrame, catalog: LabelCatalog, spark: SparkSession) -> DataFrame:  # I4, J1, J2, F8
    joined = join_catalog(predictions, catalog, spark)
    kept = joined.where(F.col("taxonomy") == F.col("catalog_taxonomy"))
    return kept.drop("catalog_taxonomy").withColumn("selected", F.col("score") >= F.col("threshold"))


def rejected_predictions(predictions: DataFrame, catalog: LabelCatalog, spark: SparkSession) -> DataFrame:  # J1 audit
    joined = join_catalog(predictions, catalog, spark)
    reason = (
        F.when(F.col("ord").isNull(), F.lit("unknown_label"))
        .when(F.col("taxonomy") != F.col("catalog_taxonomy"), F.lit("taxonomy_mismatch"))
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop(
        "ord", "catalog_taxonomy", "threshold"
    )


# Repository label sets are broadcast while all their labels together are at
# most this many (about 30 bytes each); they are cut to catalog labels first.
BROADCAST_LABELS = 2_000_000
# Beyond that the join is a shuffle join; a repository with more events than
# this has them spread over SALTS partitions.
HOT_REPOSITORY_ROWS = 1_000_000
SALTS = 64


def missing_repo_labels(plans: DataFrame, repo_labels: DataFrame, catalog: LabelCatalog,
                        broadcast_labels: int = BROADCAST_LABELS, hot_rows: int = HOT_REPOSITORY_ROWS,
                        salts: int = SALTS) -> DataFrame:  # J3
    """Attach ``missing_labels``: chosen labels absent from the repository.

    ``repo_labels`` is one row per (owner, repo) with its label set. When one
    repository carries most events (the usual case), its key would be one hot
    partition: the label sets are therefore broadcast when their measured size
    allows, and otherwise the hot repositories' events are salted.
    """
    key = ["owner", "repo"]
    known = F.array(*[F.lit(x) for x in catalog.labels])
    sets = repo_labels.select(*key, F.array_intersect("labels", known).alias("repo_label_set"))
    size = sets.agg(F.coalesce(F.sum(F.size("repo_label_set") + 1), F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast_labels:
        joined = plans.join(F.broadcast(sets), key, "left")
    elif plans.isStreaming:  # a micro-batch is bounded by its trigger
        joined = plans.join(sets, key, "left")
    else:
        counted = plans.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        hot = counted.select(*key, F.lit(True).alias("_hot"))  # at most events / hot_rows repositories
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("issue_number", "title"), F.lit(salts))).otherwise(F.lit(0))
        salted = plans.join(F.broadcast(hot), key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
        fan_out = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        spread = sets.join(F.broadcast(hot), key, "left").select(*key, "repo_label_set", F.explode(fan_out).alias("_salt"))
        joined = salted.join(spread, [*key, "_salt"], "left").drop("_salt")
    missing = F.array_except(F.col("labels_to_apply"), F.coalesce(F.col("repo_label_set"), F.array().cast("array<string>")))
    return joined.withColumn("missing_labels", missing).drop("repo_label_set")
