"""Landed issue pages (S1) and issue lookup.

An issues API page is a JSON array of issue objects, landed one page per
file. Pages are parsed to VARIANT and exploded; non-object items are skipped,
a page that is not an array is reported, not fatal. Values are typed by JSON
type, never coerced: a number where a string belongs becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import variant as VT
from ticketlens.functions.arrays import posexplode_computed

ISSUE_COLUMNS = ("number", "title", "body", "body_kind", "created_at", "closed_at", "html_url", "labels", "is_pull_request")


def read_issue_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed page file: (page_path, page_text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page_path"), F.col("value").alias("page_text")
    )


_typed = VT.typed


def issue_fields(item: Column) -> list[Column]:
    """Typed issue columns from one issue VARIANT."""
    raw_labels = F.try_variant_get(item, "$.labels", "array<variant>")
    names = F.transform(
        raw_labels,
        lambda x: F.when(F.schema_of_variant(F.variant_get(x, "$.name", "variant")) == "STRING",
                         F.variant_get(x, "$.name", "string")),
    )
    return [
        _typed(item, "$.number", "BIGINT", "bigint").alias("number"),
        _typed(item, "$.title", "STRING", "string").alias("title"),
        _typed(item, "$.body", "STRING", "string").alias("body"),
        F.coalesce(VT.kind(item, "$.body"), F.lit("VOID")).alias("body_kind"),
        _typed(item, "$.created_at", "STRING", "string").alias("created_at"),
        _typed(item, "$.closed_at", "STRING", "string").alias("closed_at"),
        _typed(item, "$.html_url", "STRING", "string").alias("html_url"),
        F.coalesce(names, F.array().cast("array<string>")).alias("labels"),
        F.variant_get(item, "$.pull_request", "variant").isNotNull().alias("is_pull_request"),
    ]


def valid_body(issues: DataFrame) -> Column:
    """A body must be text, JSON null or missing (views without ``body_kind`` hold typed text)."""
    return F.col("body_kind").isin("STRING", "VOID") if "body_kind" in issues.columns else F.lit(True)


def scan_issue_pages(pages: DataFrame, text_col: str = "page_text", keep: tuple[str, ...] = ()) -> DataFrame:  # S1
    """Issue objects of every page as typed rows (plus ``keep`` columns)."""
    items = posexplode_computed(
        pages, list(keep), F.try_variant_get(F.try_parse_json(text_col), "$", "array<variant>"), "item_pos", "item"
    )
    objects = items.where(VT.is_object(F.col("item")))
    return objects.select(*keep, "item_pos", *issue_fields(F.col("item")))


def bad_pages(pages: DataFrame, text_col: str = "page_text") -> DataFrame:
    """Pages that are not a JSON array (the API contract says they must be)."""
    v = F.try_parse_json(text_col)
    return pages.where(v.isNull() | F.try_variant_get(v, "$", "array<variant>").isNull())


def issue_lookup(issues: DataFrame, wanted: DataFrame) -> DataFrame:  # S6
    """Issues named in ``wanted`` (owner, repo, number): a semi-join, never a scan
    per key. Pull requests and rows with an invalid title or body are refused."""
    hits = issues.join(wanted, ["owner", "repo", "number"], "left_semi")
    return hits.where(~F.col("is_pull_request") & F.col("title").isNotNull() & valid_body(issues))
