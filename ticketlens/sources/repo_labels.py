"""Repository label pages (S5): landed label-list pages to label sets.

Every page of every repository is read (no paging protocol is needed once
pages are landed); items without a string ``name`` are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.arrays import explode_computed


def scan_label_pages(pages: DataFrame, text_col: str = "page_text") -> DataFrame:
    """(owner, repo, label) rows from pages with owner, repo and page text."""
    items = explode_computed(
        pages, ["owner", "repo"], F.try_variant_get(F.try_parse_json(text_col), "$", "array<variant>"), "item"
    )
    name = F.variant_get("item", "$.name", "variant")
    return items.where(F.schema_of_variant(name) == "STRING").select(
        "owner", "repo", F.variant_get("item", "$.name", "string").alias("label")
    )


def label_sets(repo_labels: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per repository with its distinct labels.

    With ``labels`` (a catalog) only those are gathered, so a set is bounded by
    the catalog whatever a repository lists; every repository keeps its row.
    """
    if labels is not None:
        known = F.col("label").isin(list(labels))
        repo_labels = repo_labels.withColumn("label", F.when(known, F.col("label")))
    return repo_labels.groupBy("owner", "repo").agg(F.array_sort(F.collect_set("label")).alias("labels"))
