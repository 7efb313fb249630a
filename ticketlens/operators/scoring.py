"""Scorers (I1-I3, I5): text or logits in, one score per catalog label out.

Scores are kept per issue as ``ARRAY<STRUCT<label, taxonomy, score>>`` in
catalog order: a narrow projection, no join, no explode. ``explode`` turns it
into the long form when a table of predictions is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.fixed_values import (
    DEVELOPMENT_KEYWORDS,
    KEYWORD_MATCH_SCORE,
    KEYWORD_MISS_SCORE,
    NON_PRODUCTION_SUFFIX,
)
from ticketlens.functions.arrays import posexplode_computed
from ticketlens.operators.baseline import SCORE_BYTES, SCORE_ROWS, LinearModel, linear_scores, term_numbers
from ticketlens.sources.catalog import LabelCatalog

PREDICTION_TYPE = "array<struct<label:string,taxonomy:string,score:double>>"


def _keywords_for(catalog: LabelCatalog, keywords=DEVELOPMENT_KEYWORDS) -> dict[str, tuple[str, ...]]:
    table = dict(keywords)
    return {label: table.get(label, ()) for label in catalog.labels}


def keyword_scores(text: Column, catalog: LabelCatalog, keywords=DEVELOPMENT_KEYWORDS,
                   is_lower: bool = False) -> Column:  # I1
    """0.9 when any keyword of the label is a substring of the lower-cased text, else 0.1.

    Labels without keywords always score 0.1; keyword entries for labels not
    in the catalog are ignored. Substring, not word, match. Pass an already
    lower-cased column with ``is_lower=True`` (see ``with_keyword_scores``).
    """
    lowered = text if is_lower else F.lower(text)
    items = []
    for label, taxonomy in zip(catalog.labels, catalog.taxonomies):
        words = _keywords_for(catalog, keywords)[label]
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        score = F.when(hit, F.lit(KEYWORD_MATCH_SCORE)).otherwise(F.lit(KEYWORD_MISS_SCORE))
        items.append(F.struct(F.lit(label).alias("label"), F.lit(taxonomy).alias("taxonomy"), score.alias("score")))
    return F.array(*items)


def with_keyword_scores(df: DataFrame, text_col: str, catalog: LabelCatalog, out: str = "predictions") -> DataFrame:
    """Keyword scores as a column; the text is lower-cased once, in its own projection."""
    low = f"__{out}_lower"
    scored = df.withColumn(low, F.lower(F.col(text_col)))
    return scored.withColumn(out, keyword_scores(F.col(low), catalog, is_lower=True)).drop(low)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit_scores(logits: Column, catalog: LabelCatalog) -> Column:  # I2
    """Sigmoid of each output position, labelled by catalog order.

    The model must emit exactly one logit per catalog label; any other width
    fails the task (a silent misalignment would mislabel every score).
    """
    n = len(catalog.labels)
    labels = F.array(*[F.lit(x) for x in catalog.labels])
    taxonomies = F.array(*[F.lit(x) for x in catalog.taxonomies])
    checked = F.when(F.size(logits) == n, logits).otherwise(
        F.raise_error(F.lit(f"model output width differs from the {n}-label catalog"))
    )
    return F.transform(
        checked,
        lambda x, i: F.struct(
            F.element_at(labels, i + 1).alias("label"),
            F.element_at(taxonomies, i + 1).alias("taxonomy"),
            sigmoid(x.cast("double")).alias("score"),
        ),
    )


def stamp(df: DataFrame, catalog: LabelCatalog, backend: str) -> DataFrame:  # I5
    """Model version (non-production suffix for keyword scores) and backend."""
    version = catalog.version + (NON_PRODUCTION_SUFFIX if backend == "development" else "")
    return df.withColumn("model_version", F.lit(version)).withColumn("backend", F.lit(backend))


def explode_predictions(df: DataFrame, id_cols: list[str], col: str = "predictions") -> DataFrame:
    """Long form: one row per (issue, prediction) with its position."""
    return posexplode_computed(df, list(id_cols), F.col(col), "pos", "p").select(
        *id_cols, "pos", "p.label", "p.taxonomy", "p.score"
    )


# --- I3: plugged-in batch scorers (mapInPandas) ----------------------------------

BatchScorer = Callable[[pd.Series], np.ndarray]  # texts -> (n, n_labels) scores

# Scorers run inside Python workers: their closures hold plain data only
# (tuples, dicts, numbers), so unpickling them never needs this package.


def development_batch_scorer(catalog: LabelCatalog) -> BatchScorer:
    words = [tuple(ws) for ws in _keywords_for(catalog).values()]  # catalog order
    hit_score, miss_score = float(KEYWORD_MATCH_SCORE), float(KEYWORD_MISS_SCORE)

    def score(texts: pd.Series) -> np.ndarray:
        lowered = texts.fillna("").str.lower()
        out = np.full((len(texts), len(words)), miss_score)
        for j, label_words in enumerate(words):
            hit = np.zeros(len(texts), dtype=bool)
            for word in label_words:
                hit |= lowered.str.contains(word, regex=False).to_numpy()
            out[hit, j] = hit_score
        return out

    return score


def shared_model(spark, model: LinearModel):
    """A fitted model as a broadcast of plain arrays; the labels stay on the driver for the check of the order."""
    return spark.sparkContext.broadcast(model.arrays()), model.labels


def linear_batch_scorer(catalog: LabelCatalog, model) -> BatchScorer:
    """The fitted linear model (``shared_model``): a worker unpacks it once, with its first batch."""
    shared, labels = model
    if tuple(labels) != tuple(catalog.labels):
        raise ValueError("the model's labels differ from the catalog's")

    def score(texts: pd.Series) -> np.ndarray:
        arrays = shared.value
        terms = [term_numbers(t, len(arrays[0])) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        flat = np.concatenate(terms) if terms else np.empty(0, dtype=np.int64)
        return linear_scores(flat, at, arrays)

    return score


SCORERS: dict[str, Callable[..., BatchScorer]] = {
    "development": development_batch_scorer,
    "linear": linear_batch_scorer,
}


def create_scorer(name: str, catalog: LabelCatalog, **options) -> BatchScorer:
    key = name.strip().lower()
    if key not in SCORERS:
        raise ValueError(f"Unknown scorer backend: {name!r}")
    return SCORERS[key](catalog, **options)


def score_batch(df: DataFrame, text_col: str, id_cols: list[str], catalog: LabelCatalog, scorer: BatchScorer,
                batch_size: int = 256) -> DataFrame:
    """Arrow batches through ``scorer``; output keeps ids and adds ``predictions``.

    Inside a batch (``SCORE_ROWS`` rows) texts go by length, ``batch_size`` at a time, so a model that
    pads sees texts of like length. Python returns plain score arrays; labels and
    taxonomies are attached by position in the JVM.
    """
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in id_cols) + ", scores array<double>"

    most_rows, most_bytes = SCORE_ROWS, SCORE_BYTES

    def regrouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, size = [], 0, 0
        for pdf in batches:
            while len(pdf):
                part, pdf = pdf.iloc[: most_rows - rows], pdf.iloc[most_rows - rows :]
                held.append(part)
                rows, size = rows + len(part), size + int(part[text_col].str.len().sum())
                if rows == most_rows or size >= most_bytes:
                    yield pd.concat(held, ignore_index=True)
                    held, rows, size = [], 0, 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in regrouped(batches):
            out = pdf[id_cols].copy()
            texts = pdf[text_col].reset_index(drop=True)
            order = np.argsort(texts.str.len().fillna(0).to_numpy(), kind="stable")
            scores = np.empty(len(texts), dtype=object)
            for first in range(0, len(order), batch_size):
                chosen = order[first : first + batch_size]
                for i, row in zip(chosen, scorer(texts.iloc[chosen])):
                    scores[i] = row
            out["scores"] = list(scores)
            yield out

    labels = F.array(*[F.lit(x) for x in catalog.labels])
    taxonomies = F.array(*[F.lit(x) for x in catalog.taxonomies])
    predictions = F.transform("scores", lambda x, i: F.struct(
        F.element_at(labels, i + 1).alias("label"), F.element_at(taxonomies, i + 1).alias("taxonomy"), x.alias("score")))
    return df.select(*id_cols, text_col).mapInPandas(run, schema).select(*id_cols, predictions.alias("predictions"))
