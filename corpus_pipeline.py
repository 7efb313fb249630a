"""The corpus pipeline: raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again as the next one's docs,
so a lost executor costs part of one stage. All stages but the last return the
columns of documents; rows that a stage rejects are gone for the next one.

No SQL says the same (fingerprints, automaton and tokenizer), so ORACLE_SQL is
None and the tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import decontaminate, line_dedup, quality_rules, sentencepieces, simhash
from ticketlens.llm.common import exactly, table, written
from ticketlens.llm.queries import TOKENIZER_MODEL
from ticketlens.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep."""
    return exactly(quality_rules.filter_documents(docs), COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines spread over many sources; n_chars follows the text."""
    cut, removed = line_dedup.dedup(docs)
    length = F.when(F.col(removed).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return exactly(cut.withColumn("n_chars", length), COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return exactly(simhash.keep_first(docs), COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not contaminated by benchmark items."""
    return exactly(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), COLUMNS)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number."""
    coded = sentencepieces.encode(exactly(docs, ("doc_id", "text")), sentencepieces.load(TOKENIZER_MODEL))
    return coded.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality_rules", by_quality),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", as_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
