"""Multi-label quality metrics and threshold choice.

Inputs are long tables of (item, label) pairs: ``truth`` and ``predicted``.
They are combined by one aggregation on (item, label) -- a union with flags,
partially aggregated before the shuffle -- instead of a full outer join.
Rule for labels without support or predictions: a zero denominator gives 0.

The threshold sweep never crosses scores with the grid: each score falls in
the bucket of the highest grid value it reaches, bucket counts are summed
from the top (a window over at most ``GRID_STEPS + 1`` buckets per taxonomy),
so tp/fp at every threshold come from one aggregation over the scores.

The exact sweep takes every distinct score as a threshold. Its counts from the
top are prefix sums over range partitions: sums inside a partition, plus the
totals of the partitions before it (one small row per partition and taxonomy),
so a taxonomy of any size is never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.arrays import explode_computed
from ticketlens.session import scratch_path

GRID_STEPS = 40  # thresholds i / 40 for i = 0..40 (a 0.025 grid)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def pair_flags(truth: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., label, t, p): whether each pair is true and/or predicted."""
    keys = list(keys)
    t = truth.select(*keys, "label", F.lit(1).alias("t"), F.lit(0).alias("p"))
    p = predicted.select(*keys, "label", F.lit(0).alias("t"), F.lit(1).alias("p"))
    return t.unionByName(p).groupBy(*keys, "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))


def _counts(df: DataFrame) -> list[Column]:
    return [
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum((1 - F.col("t")) * F.col("p")).alias("fp"),
        F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"),
    ]


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def micro(flags: DataFrame, group: Sequence[str] = ()) -> DataFrame:  # E1
    agg = flags.groupBy(*group).agg(*_counts(flags))
    return agg.select(*group, "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def per_label(flags: DataFrame, catalog_labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:  # E2
    """Counts and F1 for every catalog label (labels never seen get zeros).

    ``catalog_labels`` is the (bounded) catalog DataFrame with ``label``;
    with ``group`` it must also carry the group columns.
    """
    agg = flags.groupBy(*group, "label").agg(*_counts(flags))
    joined = F.broadcast(catalog_labels).join(agg, [*group, "label"], "left")
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    return joined.select(
        *group, *[c for c in catalog_labels.columns if c not in group],
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (tp + fn).alias("support"), *_scores(tp, fp, fn),
    )


def macro(per_label_df: DataFrame, group: Sequence[str] = ()) -> DataFrame:  # E2
    return per_label_df.groupBy(*group).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def exact_match(flags: DataFrame, items: DataFrame, item_col: str) -> DataFrame:  # E3
    """Share of items whose predicted label set equals the true set.

    Items without any pair (no truth, no prediction) count as exact.
    """
    wrong = flags.where(F.col("t") != F.col("p")).select(item_col).distinct()
    mismatched = wrong.agg(F.count(F.lit(1))).scalar()
    n = items.agg(F.count(F.lit(1)).alias("items")).select("items", mismatched.alias("mismatched"))
    return n.select("items", "mismatched", _ratio(F.col("items") - F.col("mismatched"), F.col("items")).alias("exact_match"))


# --- E4: threshold sweep ------------------------------------------------------------


def grid_value(i: Column) -> Column:
    return i.cast("double") / F.lit(float(GRID_STEPS))


def grid_bucket(score: Column) -> Column:
    """Index of the highest grid value <= score (-1 below the grid, capped at the top)."""
    b0 = F.floor(score * GRID_STEPS)
    b = (
        F.when(grid_value(b0 + 1) <= score, b0 + 1)
        .when(grid_value(b0) > score, b0 - 1)
        .otherwise(b0)
    )
    return F.least(F.greatest(b, F.lit(-1)), F.lit(GRID_STEPS)).cast("int")


def threshold_sweep(scored: DataFrame, truth: DataFrame, keys: Sequence[str], predictions: str = "predictions") -> DataFrame:
    """Micro P/R/F1 per (taxonomy, threshold) on the 0.025 grid.

    ``scored``: (keys..., predictions array of label, taxonomy, score), one row
    per item; ``truth``: (keys..., label), where repeated pairs count once. One
    row per item meets its set of true labels; the pairs are exploded after that
    and only counted, so the grid and the labels never go through a shuffle.
    """
    keys = list(keys)
    true_sets = truth.groupBy(*keys).agg(F.collect_set("label").alias("_true"))  # bounded by the catalog
    met = scored.join(true_sets, keys, "left")
    pairs = F.transform(predictions, lambda p: F.struct(
        p["taxonomy"].alias("taxonomy"), grid_bucket(p["score"]).alias("bucket"),
        F.coalesce(F.array_contains("_true", p["label"]), F.lit(False)).cast("int").alias("is_true")))
    marked = explode_computed(met, [], pairs, "p").select("p.*")
    buckets = marked.groupBy("taxonomy", "bucket").agg(
        F.sum("is_true").alias("n_true"), F.sum(1 - F.col("is_true")).alias("n_false"))
    totals = marked.groupBy("taxonomy").agg(F.sum("is_true").alias("total_true"))
    grid = totals.select("taxonomy", "total_true", F.explode(F.sequence(F.lit(0), F.lit(GRID_STEPS))).alias("bucket"))
    filled = grid.join(buckets, ["taxonomy", "bucket"], "left").fillna(0, ["n_true", "n_false"])
    from_top = Window.partitionBy("taxonomy").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # Scores in buckets above the top grid index never exist; every bucket >= i is predicted positive at i.
    swept = filled.select(
        "taxonomy", grid_value(F.col("bucket")).alias("threshold"),
        F.sum("n_true").over(from_top).alias("tp"), F.sum("n_false").over(from_top).alias("fp"), "total_true",
    ).withColumn("fn", F.col("total_true") - F.col("tp")).drop("total_true")
    return swept.select("taxonomy", "threshold", "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """One threshold per taxonomy: highest F1, ties to the lower threshold."""
    w = Window.partitionBy("taxonomy").orderBy(F.col("f1").desc(), F.col("threshold").asc())
    return sweep.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def distinct_scores(pairs: DataFrame) -> DataFrame:
    """(taxonomy, score, n_true, n_false): counts of every distinct score; rows without a score count for no threshold.

    ``pairs``: (taxonomy, score, is_true 0/1). NaN is no score; 0.0 and -0.0 are one.
    """
    score = F.when(~F.isnan("score"), F.col("score") + F.lit(0.0))
    return pairs.groupBy("taxonomy", score.alias("score")).agg(
        F.sum("is_true").alias("n_true"), F.sum(1 - F.col("is_true")).alias("n_false"))


def exact_sweep(pairs: DataFrame) -> DataFrame:
    """Micro P/R/F1 per (taxonomy, threshold) at every distinct score.

    ``pairs``: (taxonomy, score double, is_true 0/1), one row per scored (item,
    label). A pair is predicted if its score reaches the threshold. True pairs
    without a score (null or NaN) are missed at every threshold.
    """
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Sorted by ranges and written once: the number of a row tells its partition and its place.
    path = scratch_path(spark, "distinct-scores")
    (
        distinct_scores(pairs).repartitionByRange(parts, F.col("taxonomy"), F.col("score").desc_nulls_last())
        .sortWithinPartitions(F.col("taxonomy"), F.col("score").desc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).write.parquet(path)
    )
    rows = spark.read.parquet(path)
    # One row per partition and taxonomy in it: at most partitions + taxonomies.
    totals = rows.groupBy("taxonomy", "part").agg(F.sum("n_true").alias("part_true"), F.sum("n_false").alias("part_false"))
    before = Window.partitionBy("taxonomy").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("taxonomy")
    offsets = totals.select(
        F.col("taxonomy").alias("off_taxonomy"), F.col("part").alias("off_part"),
        F.coalesce(F.sum("part_true").over(before), F.lit(0)).alias("before_true"),
        F.coalesce(F.sum("part_false").over(before), F.lit(0)).alias("before_false"),
        F.sum("part_true").over(every).alias("total_true"),
    )
    inside = Window.partitionBy("part", "taxonomy").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.where("score IS NOT NULL").select(
        "taxonomy", "score", "part", F.sum("n_true").over(inside).alias("here_true"), F.sum("n_false").over(inside).alias("here_false"))
    same = summed["taxonomy"].eqNullSafe(offsets["off_taxonomy"]) & (F.col("part") == F.col("off_part"))
    swept = summed.join(F.broadcast(offsets), same).select(
        "taxonomy", F.col("score").alias("threshold"),
        (F.col("before_true") + F.col("here_true")).alias("tp"), (F.col("before_false") + F.col("here_false")).alias("fp"), "total_true",
    ).withColumn("fn", F.col("total_true") - F.col("tp")).drop("total_true")
    return swept.select("taxonomy", "threshold", "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def best_exact(sweep: DataFrame) -> DataFrame:
    """As ``best_thresholds`` for sweeps of any length: a maximum that is combined before the shuffle, no ranking."""
    rest = [c for c in sweep.columns if c != "taxonomy"]
    best = sweep.groupBy("taxonomy").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("f1"), (-F.col("threshold")).alias("low"))).alias("best"))
    return best.select("taxonomy", *[F.col(f"best.{c}").alias(c) for c in rest])


# --- E5: seed comparison ------------------------------------------------------------


def seed_comparison(run_metrics: DataFrame, baseline_model: str, metric: str = "f1") -> DataFrame:
    """Per model: mean over seeds, seeds won, and the gap to the baseline's mean.

    ``run_metrics``: (model, seed, <metric>), one row per training run.
    """
    per_model = run_metrics.groupBy("model").agg(
        F.avg(metric).alias("mean_metric"), F.count(F.lit(1)).alias("seeds"))
    winners = run_metrics.groupBy("seed").agg(F.max_by("model", F.struct(F.col(metric), F.col("model"))).alias("model"))
    wins = winners.groupBy("model").agg(F.count(F.lit(1)).alias("wins"))
    base = per_model.where(F.col("model") == baseline_model).select(F.col("mean_metric").alias("baseline"))
    out = per_model.join(wins, "model", "left").fillna(0, ["wins"])
    base_value = base.select("baseline").scalar()
    return out.select("model", "mean_metric", "seeds", "wins", (F.col("mean_metric") - base_value).alias("delta_to_baseline"))
