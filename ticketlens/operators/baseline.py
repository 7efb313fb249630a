"""TF-IDF + logistic regression baseline (E6), fitted by the executors on all training rows.

Features: word tokens of the model input, hashed to ``NUM_FEATURES`` terms, term
frequency times smoothed IDF, rows of unit length. One logistic regression per
catalog label; all of them share the features, so a row is read once for all.

The fit is iterative parameter mixing: training rows are dealt to blocks by the
hash of their id, every block makes one pass of per-coordinate (AdaGrad) steps
from the shared weights, and the weights of a term are averaged over the blocks
that hold it, weighted by how many of their rows do. A few such rounds follow.
Rows never leave their block and no optimiser history exists; what the driver
holds is one matrix of ``NUM_FEATURES`` x labels single floats, whatever the
number of rows. The same rows give the same model: blocks, the order in them
and the order of sums are fixed.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import scratch_path

# Functions travel to workers by value: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUM_FEATURES = 1 << 18
#: Training rows of a block, on average.
BLOCK_ROWS = 8_192
ROUNDS = 4
RATE = 0.5
#: Bytes of text whose terms one task counts, on average.
TASK_BYTES = 8 << 20
#: Rows and bytes scored as one run of steps: what is scored together does not follow the size of the Arrow batches.
SCORE_ROWS = 10_000
SCORE_BYTES = 64 << 20
#: Tokens of the rows that make one step (or are scored) together.
_STEP_TOKENS = 8_192
#: Rows of a step of the fit at most.
_STEP_ROWS = 16


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")


def sparse_tfidf(rows: DataFrame, train: DataFrame, id_col: str = "sample_id", text_col: str = "model_input") -> DataFrame:
    """(id, term, tf, weight) with weight = tf * ln((n + 1) / (df + 1)), n and df counted on ``train``.

    The rows are dealt by id to tasks of about ``TASK_BYTES`` of text, where the
    terms of an id are counted without a further shuffle (a frequent word is one
    partial row per task); a term no training row holds gets df = 0.
    """

    def terms(df: DataFrame) -> DataFrame:
        size = df.agg(F.sum(F.octet_length(text_col).cast("long")).alias("s")).first()["s"] or 0
        dealt = df.select(id_col, text_col).repartition(size // TASK_BYTES + 1, id_col)
        return dealt.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))

    tf = terms(rows).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = terms(train).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = train.count()
    idf = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    # Hashed by the side with a row per term: the counts of all rows are not sorted.
    return tf.join(df_.hint("shuffle_hash"), "term", "left").select(id_col, "term", "tf", (F.col("tf") * idf).alias("weight"))


def hashed_terms(text: Column, features: int = NUM_FEATURES) -> Column:
    """The tokens of a text as term numbers below ``features``, repeats included."""
    return F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def term_numbers(text: str | None, features: int = NUM_FEATURES):
    """``hashed_terms`` of one text outside the JVM (same lower case, word class and hash)."""
    import re

    import numpy as np
    from xxhash import xxh64_intdigest

    found = re.findall(r"\w+", text.lower(), re.ASCII) if text else []
    hashes = np.array([xxh64_intdigest(t, 42) for t in found], dtype=np.uint64)
    return hashes.view(np.int64) % features


@dataclass(frozen=True)
class LinearModel:
    """A fitted model: plain arrays, which is all that is ever sent to a worker."""

    labels: tuple[str, ...]
    idf: object  # float32 [features]
    weights: object  # float32 [features, labels]
    bias: object  # float32 [labels]

    def arrays(self) -> tuple:
        return self.idf, self.weights, self.bias


def idf_of(train: DataFrame, terms_col: str = "terms", features: int = NUM_FEATURES):
    """Smoothed IDF of every term over all training rows (at most ``features`` counts come back)."""
    import numpy as np

    df_ = train.select(F.explode(F.array_distinct(terms_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = df_.toArrow()
    n = train.count()
    counts = np.zeros(features, dtype=np.float64)
    counts[found["term"].to_numpy()] = found["df"].to_numpy()
    return (np.log((n + 1.0) / (counts + 1.0)) + 1.0).astype(np.float32), n


def _steps(offsets, most: int = 1024) -> Iterator[tuple[int, int]]:
    """At most so many consecutive rows, together about ``_STEP_TOKENS`` tokens."""
    first = 0
    for last in range(1, len(offsets)):
        if last == len(offsets) - 1 or last - first == most or offsets[last + 1] - offsets[first] > _STEP_TOKENS:
            yield first, last
            first = last


def _matrix(flat, offsets, idf):
    """(terms, rows x terms matrix of unit TF-IDF rows) of a few rows."""
    import numpy as np

    used, at = np.unique(flat, return_inverse=True)
    rows = len(offsets) - 1
    cell = np.repeat(np.arange(rows), np.diff(offsets)) * len(used) + at
    m = np.bincount(cell, minlength=rows * len(used)).reshape(rows, len(used)).astype(np.float32) * idf[used]
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return used, m / np.where(norm > 0, norm, 1)


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    train: DataFrame, targets: Sequence[str], labels: Sequence[str], id_col: str = "sample_id", text_col: str = "model_input",
    features: int = NUM_FEATURES, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS, rate: float = RATE,
) -> LinearModel:
    """Minimise log loss + |w|^2 / (2 n) of every target column (0/1) over all training rows."""
    import numpy as np
    import pyarrow as pa

    spark = train.sparkSession
    path = scratch_path(spark, "baseline-terms")
    train.select(
        F.xxhash64(id_col).alias("id"), hashed_terms(F.col(text_col), features).alias("terms"),
        F.array(*[F.col(t).cast("float") for t in targets]).alias("y"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    idf, n = idf_of(rows, "terms", features)
    width = len(targets)
    weights, bias = np.zeros((features, width), dtype=np.float32), np.zeros(width, dtype=np.float32)
    if not n:
        return LinearModel(tuple(labels), idf, weights, bias)
    blocks = math.ceil(n / block_rows)
    dealt = rows.withColumn("block", F.pmod("id", F.lit(blocks)).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * blocks)  # at most features / 8 rows of weights each

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((idf, weights, bias))

        def learn(table):
            table = table.sort_by("id")
            idf, weights, bias = shared.value
            w, b = weights.copy(), bias.copy()
            past, past_b = np.zeros_like(w), np.zeros_like(b)
            seen = np.zeros(len(w), dtype=np.int64)
            lists = table["terms"].combine_chunks()
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            y = table["y"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            for first, last in _steps(at, _STEP_ROWS):
                used, m = _matrix(flat[at[first] : at[last]], at[first : last + 1] - at[first], idf)
                error = (_sigmoid(m @ w[used] + b) - y[first:last]) / (last - first)
                grad, grad_b = m.T @ error + w[used] / n, error.sum(axis=0)
                past[used] += grad * grad
                past_b += grad_b * grad_b
                w[used] -= rate * grad / np.sqrt(past[used] + 1e-8)
                b -= rate * grad_b / np.sqrt(past_b + 1e-8)
                seen[used] += (m > 0).sum(axis=0)
            terms = np.flatnonzero(seen)
            values = np.vstack([w[terms], b])
            return pa.table({
                "term": pa.array(np.append(terms, len(w)).astype(np.int32)),
                "block": pa.array(np.full(len(terms) + 1, table["block"][0].as_py(), dtype=np.int32)),
                "rows": pa.array(np.append(seen[terms], table.num_rows)),
                "w": pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), width).cast(pa.list_(pa.float32())),
            })

        def mix(table):
            table = table.sort_by([("term", "ascending"), ("block", "ascending")])
            term, count = table["term"].to_numpy(), table["rows"].to_numpy().astype(np.float64)
            w = table["w"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            mean = np.add.reduceat(w * count[:, None], at) / np.add.reduceat(count, at)[:, None]
            out = pa.FixedSizeListArray.from_arrays(pa.array(mean.astype(np.float32).ravel()), width)
            return pa.table({"term": pa.array(term[at]), "w": out.cast(pa.list_(pa.float32()))})

        learnt = dealt.groupBy("block").applyInArrow(learn, "term int, block int, rows long, w array<float>")
        mixed = learnt.groupBy(F.pmod("term", F.lit(parts)).alias("part")).applyInArrow(
            lambda table: mix(table.drop_columns(["part"]) if "part" in table.column_names else table), "term int, w array<float>"
        ).toArrow()
        shared.destroy()
        terms = mixed["term"].to_numpy()
        values = mixed["w"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        weights, bias = np.zeros_like(weights), values[terms == features][0].copy()
        weights[terms[terms < features]] = values[terms < features]
    return LinearModel(tuple(labels), idf, weights, bias)


def linear_scores(flat, offsets, arrays):
    """(rows, labels) scores of rows of term numbers."""
    import numpy as np

    idf, weights, bias = arrays
    out = np.empty((len(offsets) - 1, len(bias)), dtype=np.float64)
    for first, last in _steps(offsets):
        used, m = _matrix(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], idf)
        out[first:last] = _sigmoid((m @ weights[used] + bias).astype(np.float64))
    return out


def regrouped(batches: Iterator) -> Iterator:
    """The same Arrow rows in order, as batches of ``SCORE_ROWS`` rows (fewer beyond ``SCORE_BYTES``)."""
    import pyarrow as pa

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held, rows, size = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SCORE_ROWS - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows == SCORE_ROWS or size >= SCORE_BYTES:
                yield joined()
                held, rows, size = [], 0, 0
    if held:
        yield joined()


def score_labels(rows: DataFrame, model: LinearModel, id_cols: Sequence[str], text_col: str = "model_input") -> DataFrame:
    """Long form (ids..., label, score) with score = P(label | text), for every row."""
    features = len(model.idf)
    shared = rows.sparkSession.sparkContext.broadcast(model.arrays())
    width = len(id_cols)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in regrouped(batches):
            lists = batch.column(width)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            scores = linear_scores(lists.flatten().to_numpy(), at, shared.value)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), scores.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], flat], names=[*id_cols, "scores"])

    slim = rows.select(*id_cols, hashed_terms(F.col(text_col), features).alias("terms"))
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in id_cols) + ", scores array<double>"
    labels = F.array(*[F.lit(x) for x in model.labels])
    scored = slim.mapInArrow(run, schema)
    return scored.select(*id_cols, F.posexplode_outer("scores").alias("pos", "score")).where("score IS NOT NULL").select(
        *id_cols, F.element_at(labels, F.col("pos") + 1).alias("label"), "score"
    )
