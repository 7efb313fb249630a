"""Label catalog and model bundle.

The catalog is configuration: an ordered list of labels with taxonomy and
threshold. Per-row operators inline it as literals (arrays, maps); the long
forms join its DataFrame, which also suits catalogs of many thousands of labels.

``bundle_checks`` evaluates every rule on a table of bundles (manifest, label
schema, thresholds as VARIANT), one row per failed rule; values are typed by
JSON type, never coerced. ``load_artifacts`` refuses a bundle with violations.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    DATASET_TAXONOMY_PREFIXES,
    LABEL_CATALOG,
    MIN_MAX_LENGTH,
    MODEL_BACKEND,
    MODEL_MAX_LENGTH,
    MODEL_VERSION,
    SUPPORTED_TAXONOMIES,
    TEXT_CONTRACT_VERSION,
)


class ArtifactError(ValueError):
    pass


@dataclass(frozen=True)
class LabelCatalog:
    labels: tuple[str, ...]
    taxonomies: tuple[str, ...]
    thresholds: tuple[float, ...]
    version: str = MODEL_VERSION
    backend: str = MODEL_BACKEND
    max_length: int = MODEL_MAX_LENGTH
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if not (len(self.labels) == len(self.taxonomies) == len(self.thresholds)):
            raise ArtifactError("catalog columns differ in length")

    @classmethod
    def shipped(cls) -> LabelCatalog:
        labels, taxonomies, thresholds = zip(*LABEL_CATALOG)
        return cls(tuple(labels), tuple(taxonomies), tuple(float(t) for t in thresholds))

    @classmethod
    def with_thresholds(cls, labels: Sequence[str], thresholds: dict[str, float], **kw) -> LabelCatalog:
        return cls(
            tuple(labels),
            tuple(label.split("/", 1)[0] for label in labels),
            tuple(float(thresholds[label]) for label in labels),
            **kw,
        )

    # --- Spark forms -------------------------------------------------------

    def dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(i, lab, tax, thr) for i, (lab, tax, thr) in enumerate(zip(self.labels, self.taxonomies, self.thresholds))]
        return spark.createDataFrame(rows, "ord int, label string, taxonomy string, threshold double")

    def _map(self, values) -> Column:
        pairs = []
        for label, value in zip(self.labels, values):
            pairs += [F.lit(label), F.lit(value)]
        return F.create_map(*pairs)

    def taxonomy_of(self, label: Column) -> Column:
        return self._map(self.taxonomies)[label]

    def label_at(self, ord_: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), ord_ + 1)


# --- bundle loading -------------------------------------------------------------


def read_json_object(spark: SparkSession, path) -> DataFrame:
    """One row (path, v VARIANT) per JSON file; v is NULL for unreadable JSON."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return raw.select("path", F.try_parse_json("value").alias("v"))


BUNDLE_FILES = {"m": "model_manifest.json", "s": "label_schema.json", "t": "thresholds.json"}


def read_bundle(spark: SparkSession, directory: str) -> DataFrame:
    """One row (m, s, t) of VARIANTs from the three bundle files, one scan.

    A missing file fails the read, like a missing artifact.
    """
    d = directory.rstrip("/")
    raw = read_json_object(spark, [f"{d}/{name}" for name in BUNDLE_FILES.values()])
    # a bundle file is a plain file or a directory of one part (Spark-written)
    name = F.regexp_extract("path", r"([^/]+\.json)(?:/[^/]*)?$", 1)
    return raw.agg(*[
        F.first(F.when(name == file, F.col("v")), ignorenulls=True).alias(key) for key, file in BUNDLE_FILES.items()
    ])


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def bundle_checks(bundles: DataFrame, backend: str | None = None, contract: str = TEXT_CONTRACT_VERSION) -> DataFrame:
    """One row per failed rule of bundles (columns m, s, t; all other columns are kept)."""
    m, s, t = F.col("m"), F.col("s"), F.col("t")
    keys = [c for c in bundles.columns if c not in ("m", "s", "t")]
    values = F.when(F.variant_get(t, "$.values", "variant").isNotNull(), F.variant_get(t, "$.values", "variant")).otherwise(t)
    raw_labels = F.try_variant_get(m, "$.labels", "array<variant>")
    manifest_labels = F.try_variant_get(m, "$.labels", "array<string>")
    schema_items = F.try_variant_get(s, "$.labels", "array<variant>")
    raw_thresholds = F.try_variant_get(values, "$", "map<string,variant>")

    def field(item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "variant")

    def text(item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "string")

    schema_names = F.transform(schema_items, lambda x: text(x, "name"))
    typed_items = F.forall(schema_items, lambda x: _is_string(field(x, "name")) & _is_string(field(x, "taxonomy")))

    checks = [
        ("manifest_not_object", ~_kind(m, "$").startswith("OBJECT")),
        ("schema_not_object", ~_kind(s, "$").startswith("OBJECT")),
        ("thresholds_not_object", ~_kind(t, "$").startswith("OBJECT")),
        ("missing_model_version", (_kind(m, "$.model_version") != "STRING")
         | (F.try_variant_get(m, "$.model_version", "string") == "")),
        ("missing_backend", _kind(m, "$.backend") != "STRING"),
        ("labels_not_ordered_list", raw_labels.isNull() | ~F.forall(raw_labels, _is_string)),
        ("duplicate_manifest_labels", F.size(F.array_distinct(manifest_labels)) != F.size(manifest_labels)),
        ("invalid_max_length", (_kind(m, "$.max_length") != "BIGINT")
         | (F.try_variant_get(m, "$.max_length", "bigint") < MIN_MAX_LENGTH)),
        ("schema_labels_not_list", schema_items.isNull()),
        ("schema_label_not_typed", ~typed_items),
        ("invalid_taxonomy", F.exists(schema_items, lambda x: ~F.coalesce(
            text(x, "taxonomy").isin(*SUPPORTED_TAXONOMIES)
            & text(x, "name").startswith(F.concat(text(x, "taxonomy"), F.lit("/"))), F.lit(False)))),
        ("schema_manifest_order", ~F.coalesce(schema_names == manifest_labels, F.lit(False))),
        ("threshold_labels", ~F.coalesce(
            F.array_sort(F.map_keys(raw_thresholds)) == F.array_sort(manifest_labels), F.lit(False))),
        ("threshold_not_number", F.exists(F.map_values(raw_thresholds), lambda x: ~F.coalesce(
            F.schema_of_variant(x).rlike(_NUMBER), F.lit(False)))),
        ("threshold_range", F.exists(F.map_values(raw_thresholds), lambda x: ~F.coalesce(
            F.try_variant_get(x, "$", "double").between(0.0, 1.0), F.lit(False)))),
        ("preprocessing_version", (F.try_variant_get(m, "$.backend", "string") == "transformer")
         & ~F.coalesce(F.try_variant_get(m, "$.preprocessing_version", "string") == contract, F.lit(False))),
    ]
    if backend is not None:
        checks.append(("backend_mismatch", ~F.coalesce(F.try_variant_get(m, "$.backend", "string") == backend, F.lit(False))))
    flagged = bundles.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.coalesce(cond, F.lit(True)).alias("failed")) for rule, cond in checks
    ])))
    return flagged.where("failed").select(*keys, "rule")


def bundle_violations(spark: SparkSession, directory: str, backend: str | None = None,
                      contract: str = TEXT_CONTRACT_VERSION) -> DataFrame:
    """One row per failed rule of a bundle directory; empty when the bundle is valid."""
    return bundle_checks(read_bundle(spark, directory), backend, contract)


def load_artifacts(spark: SparkSession, directory: str, backend: str | None = None,
                   contract: str = TEXT_CONTRACT_VERSION) -> LabelCatalog:
    """Validated catalog from a bundle; raises with every failed rule."""
    bad = [r["rule"] for r in bundle_violations(spark, directory, backend, contract).collect()]
    if bad:
        raise ArtifactError("invalid model bundle: " + ", ".join(sorted(bad)))
    row = read_bundle(spark, directory).select(
        F.variant_get("m", "$.labels", "array<string>").alias("labels"),
        F.variant_get("m", "$.model_version", "string").alias("version"),
        F.variant_get("m", "$.backend", "string").alias("backend"),
        F.variant_get("m", "$.max_length", "int").alias("max_length"),
        F.coalesce(F.try_variant_get("t", "$.values", "map<string,double>"),
                   F.try_variant_get("t", "$", "map<string,double>")).alias("thresholds"),
    ).first()  # one row of configuration
    return LabelCatalog.with_thresholds(
        row["labels"], dict(row["thresholds"]), version=row["version"], backend=row["backend"],
        max_length=row["max_length"],
    )


def bundle_payloads(catalog: LabelCatalog, model_name: str = "ticketlens", strategy: str = "taxonomy") -> dict[str, dict]:
    """Manifest, label schema and thresholds of a catalog, by bundle key."""
    return {
        "m": {
            "model_name": model_name, "model_version": catalog.version, "backend": catalog.backend,
            "max_length": catalog.max_length, "preprocessing_version": TEXT_CONTRACT_VERSION,
            "labels": list(catalog.labels), "threshold_strategy": strategy,
        },
        "s": {"labels": [{"name": lab, "taxonomy": tax} for lab, tax in zip(catalog.labels, catalog.taxonomies)]},
        "t": {"strategy": strategy, "values": dict(zip(catalog.labels, catalog.thresholds))},
    }


def write_bundle(spark: SparkSession, directory: str, catalog: LabelCatalog, model_name: str = "ticketlens",
                 strategy: str = "taxonomy") -> str:
    """Write manifest, label schema and thresholds as a bundle (Spark writers, so
    shared storage works); refuses an existing target."""
    d = directory.rstrip("/")
    for key, payload in bundle_payloads(catalog, model_name, strategy).items():
        text = spark.createDataFrame([(json.dumps(payload),)], "value string")
        text.coalesce(1).write.mode("errorifexists").text(f"{d}/{BUNDLE_FILES[key]}")
    return d


def label_rule_violations(candidates: DataFrame, label_col: str = "label") -> DataFrame:  # S4 rules
    """Dataset-side label rules over a candidate label column: (label, rule).

    A label must be a string, start with a supported prefix, and occur once.
    """
    prefix_ok = F.lit(False)
    for prefix in DATASET_TAXONOMY_PREFIXES:
        prefix_ok = prefix_ok | F.col(label_col).startswith(prefix)
    counted = candidates.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    rule = (
        F.when(F.col(label_col).isNull(), F.lit("not_a_string"))
        .when(F.col(label_col) == "", F.lit("empty"))
        .when(~prefix_ok, F.lit("unsupported_taxonomy"))
        .when(F.col("n") > 1, F.lit("duplicate"))
    )
    return counted.select(F.col(label_col).alias("label"), "n", rule.alias("rule")).where(F.col("rule").isNotNull())
