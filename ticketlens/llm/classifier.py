"""Quality classifier (operator 5): positive-unlabelled learning.

Trusted positives are the labelled good documents; the unlabelled set is web
text drawn from the corpus, good and bad mixed. With the class prior p the
logistic risk is  p R+(positives) + max(0, R-(unlabelled) - p R-(positives));
when the second term falls below zero its gradient is turned round, which keeps
a flexible model from driving it negative (the non-negative risk estimator).
The prior is the share of good documents among the labelled training rows.

The model is linear over shape features of the whole text and hashed byte
bigrams. Features are computed once and written; their means and deviations are
those of all documents that are not held out. A first fit on the driver takes a
bounded sample (``max_positives`` and ``max_unlabelled`` documents, chosen by
the smallest hash of the id, so the choice is fixed). It is only the start:
``passes`` steps follow whose unlabelled risk and gradient are sums over all
documents that are not held out, made by the executors; the driver gets one
number per feature. Only the positives, which are labelled rows, stay bounded.

Cases: a null or empty text has all-zero features and gets a score like any
other; null labels are ignored; a null id is never held out nor sampled, but
counts in the statistics and the unlabelled risk;
repeated ids give repeated rows (a label counts once per labelled id); without
positives or documents the scores are the prior (0.5 if that is unknown too);
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import written

FOLDS = 5
THRESHOLD = 0.3
MAX_POSITIVES = 3_000
MAX_UNLABELLED = 6_000
#: Steps over all documents that are not held out, and the size of the first one.
PASSES = 12
PASS_RATE = 0.02
BIGRAM_BINS = 256
_SYMBOLS = b"#*$%&|<>"
_SHAPE = 18


@dataclass(frozen=True)
class Model:
    """Standardisation and weights of the linear model: plain data."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float


def features(text: str | None):
    """Feature vector of a whole text (bounded work memory beside the text itself)."""
    import numpy as np

    out = np.zeros(_SHAPE + BIGRAM_BINS, dtype=np.float64)
    raw = text.encode("utf-8") if text else b""
    if not raw:
        return out
    codes = np.frombuffer(raw, dtype=np.uint8)
    n = len(codes)
    count = np.bincount(codes, minlength=256)
    ws = raw.split()
    m = max(1, len(ws))
    lines = [ln for ln in raw.split(b"\n") if ln.strip()]
    again = sum(a == b for a, b in zip(ws, ws[1:]))
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    out[:_SHAPE] = (
        np.log1p(len(ws)), n / m / 10, count[65:91].sum() / n, count[48:58].sum() / n, count[128:].sum() / n,
        sum(int(count[c]) for c in _SYMBOLS) / n, count[33] / n, count[124] / n, (count[46] + count[44]) / n,
        count[10] / n, letters / n, len(set(ws)) / m, again / m,
        sum(w.isupper() for w in ws) / m, sum(len(w) == 1 for w in ws) / m,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), 1.0 if len(ws) < 20 else 0.0,
    )
    # Hashed bigrams in blocks: 64 KB of codes at a time.
    bins = np.zeros(BIGRAM_BINS, dtype=np.int64)
    for at in range(0, n - 1, 1 << 16):
        part = codes[at : at + (1 << 16) + 1].astype(np.int32)
        bins += np.bincount((part[:-1] * 31 + part[1:] * 7) % BIGRAM_BINS, minlength=BIGRAM_BINS)
    out[_SHAPE:] = np.sqrt(bins / max(1, n - 1))
    return out


def _constant(prior: float) -> Model:
    """The model without positives or documents: every score is the prior."""
    import numpy as np

    width = _SHAPE + BIGRAM_BINS
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return Model((0.0,) * width, (1.0,) * width, (0.0,) * width, float(np.log(p / (1 - p))), prior)


def _sigmoid(z):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(p_rows, unlabelled, prior: float, w, b: float, rounds: int, rate, decay: float):
    """Adam steps on the non-negative risk; ``unlabelled(w, b)`` gives mean R- of the unlabelled and its gradient."""
    import numpy as np

    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        zp = p_rows @ w + b
        # Logistic loss: R+ on positives is softplus(-z), R- is softplus(z).
        risk_u, grad_u = unlabelled(w, b)
        on_p, on_n = -prior * _sigmoid(-zp) / len(zp), -prior * _sigmoid(zp) / len(zp)
        if risk_u < prior * np.logaddexp(0.0, zp).mean():
            on_p, on_n, grad_u = 0.0 * on_p, -on_n, -grad_u
        on_p = on_p + on_n
        grad = np.append(p_rows.T @ on_p + decay * w, on_p.sum()) + grad_u
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate(t) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(
    positive, unlabelled, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3, moments=None,
) -> Model:
    """Minimise the non-negative unbiased risk of a sample by full-batch Adam steps (no randomness).

    ``moments``: mean and deviation of the features (default: those of ``unlabelled``).
    """
    import numpy as np

    if not len(positive) or not len(unlabelled):
        return _constant(prior)
    mean, scale = moments or (unlabelled.mean(axis=0), unlabelled.std(axis=0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    rows = _standard(unlabelled, mean, scale)

    def risk(w, b):
        z = rows @ w + b
        on = _sigmoid(z) / len(z)
        return np.logaddexp(0.0, z).mean(), np.append(rows.T @ on, on.sum())

    p_rows = _standard(positive, mean, scale)
    w, b = _descend(p_rows, risk, prior, np.zeros(p_rows.shape[1]), 0.0, rounds, lambda t: rate, decay)
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), b, float(prior))


def _standard(rows, mean, scale):
    import numpy as np

    return np.clip((rows - mean) / scale, -8.0, 8.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, those of the smallest hash."""
    return ids.filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _matrix(column):
    """Rows of features of a binary Arrow column."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, _SHAPE + BIGRAM_BINS).astype(np.float64)


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, v): the features of every document as 32-bit numbers in a binary, written once."""

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype("float32").tobytes() for t in texts], dtype=object)

    return written(docs.sparkSession, docs.select("doc_id", vector("text").alias("v")), "classifier-vectors")


def _summed(rows: DataFrame, sums, names: tuple[str, ...]):
    """Columns of numbers per place: ``sums(matrix)`` (names x places) added up over all rows by the executors."""
    import numpy as np

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        total = 0.0
        for batch in parts:
            if batch.num_rows:
                total = total + sums(_matrix(batch.column(0)))
        if not isinstance(total, float):
            places = pa.array(np.arange(total.shape[1]), pa.int64())
            yield pa.RecordBatch.from_arrays([places, *[pa.array(t) for t in total]], names=["place", *names])

    schema = "place long, " + ", ".join(f"{n} double" for n in names)
    found = rows.select("v").mapInArrow(run, schema).groupBy("place").agg(*[F.sum(n).alias(n) for n in names])
    return np.array([[r[n] for n in names] for r in sorted(found.collect())]).T  # one row per feature


def train(
    vecs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
    passes: int = PASSES,
) -> Model:
    """Fit on ``vectors`` of the documents and labels (doc_id, quality); held-out rows take no part."""
    import numpy as np

    spark = vecs.sparkSession
    known = labels.select("doc_id", "quality").filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    share = known.agg(F.avg((F.col("quality") == 1).cast("double")).alias("p")).first()["p"]
    prior = 0.5 if share is None else float(share)
    mine = vecs.filter(~held_out(F.col("doc_id")))
    # Both samples are bounded by their parameters, so they may be broadcast.
    chosen = _sampled(known.filter("quality = 1").select("doc_id"), max_positives).withColumn("positive", F.lit(True)).unionByName(
        _sampled(mine.select("doc_id"), max_unlabelled).withColumn("positive", F.lit(False))
    )
    rows = (
        mine.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "positive"]).select("doc_id", "positive", "v").toPandas()
    ).sort_values(["positive", "doc_id"])
    width = _SHAPE + BIGRAM_BINS

    def matrix(flag: bool):
        part = rows[rows["positive"] == flag]["v"]
        return np.frombuffer(b"".join(map(bytes, part)), dtype=np.float32).reshape(-1, width).astype(np.float64)

    positive, unlabelled = matrix(True), matrix(False)
    if not len(positive) or not len(unlabelled):
        return _constant(prior)
    # Sums of doubles depend on their order in the last digits: rounding keeps the model the same in every run.
    count, total, squares = _summed(mine, lambda x: np.stack([np.ones(width) * len(x), x.sum(axis=0), (x * x).sum(axis=0)]), ("n", "s", "q"))
    many, mean = count[0], np.round(total / count, 9)
    scale = np.round(np.sqrt(np.maximum(squares / count - (total / count) ** 2, 0.0)), 9)
    start = fit(positive, unlabelled, prior, moments=(mean, scale))
    scale = np.array(start.scale)

    def risk(w, b):
        shared = spark.sparkContext.broadcast((mean, scale, w, b))

        def sums(x):
            mean, scale, w, b = shared.value
            x = _standard(x, mean, scale)
            z = x @ w + b
            on = _sigmoid(z)
            return np.concatenate([on @ x, [on.sum(), np.logaddexp(0.0, z).sum()]])[None, :]

        found = np.round(_summed(mine, sums, ("g",))[0] / many, 9)
        shared.destroy()
        return found[-1], found[:-1]

    w, b = _descend(
        _standard(positive, mean, scale), risk, prior, np.array(start.weights), start.bias, passes,
        lambda t: PASS_RATE / t**0.5, decay=1e-3,
    )
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), b, prior)


def score(v: Column, model: Model, spark) -> Column:
    """The score (0 to 1; higher: good is likelier) of a column of ``vectors``."""
    # A plain tuple: broadcast values name their classes' module, which workers need not have.
    shared = spark.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        m = Model(*shared.value)
        mean, scale, w = np.array(m.mean), np.array(m.scale), np.array(m.weights)
        for rows in parts:
            z = [float(_standard(np.frombuffer(r, dtype=np.float32).astype(np.float64), mean, scale) @ w) + m.bias for r in rows]
            yield pd.Series(_sigmoid(np.array(z, dtype=np.float64)))

    return scored(v)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    vecs = vectors(docs.select("doc_id", "text"))
    model = train(vecs, labels)
    scored = vecs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("v"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
