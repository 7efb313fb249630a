"""The distributed fit against an exact one, and the fitted model behind the batch scorer."""

from __future__ import annotations

import numpy as np
import pytest

from ticketlens.operators import baseline as B
from ticketlens.operators import scoring as S
from ticketlens.sources.catalog import LabelCatalog

WORDS = "volume mount lost token expired early node kubelet crash pod pending network policy drops".split()


def texts(n):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = rng.choice(WORDS, 12).tolist() + [f"rare{int(rng.integers(0, 40))}"]
        rows.append((f"s{i}", " ".join(words), int("volume" in words), int(words.count("token") + words.count("node") > 2)))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(texts(600), "sample_id string, model_input string, t_a int, t_b int")


def dense(model, data):
    """Unit TF-IDF rows, worked out word by word."""
    out = []
    for _, text, *_ in data:
        v = np.zeros(len(model.idf))
        for t in B.term_numbers(text, len(model.idf)):
            v[t] += model.idf[t]
        out.append(v / np.linalg.norm(v))
    return np.array(out)


def exact(x, y):
    """The minimum of mean log loss + |w|^2 / (2 n), by Newton steps."""
    n = len(x)
    xb = np.hstack([x, np.ones((n, 1))])
    ridge = np.eye(xb.shape[1]) / n
    ridge[-1, -1] = 1e-9
    w = np.zeros(xb.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve((xb.T * (p * (1 - p))) @ xb / n + ridge, xb.T @ (p - y) / n + ridge @ w)
    return 1 / (1 + np.exp(-xb @ w))


def loss(p, y):
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


@pytest.mark.parametrize("block_rows", [600, 100])
def test_fit_comes_close_to_the_exact_one(spark, rows, block_rows):
    data = texts(600)
    model = B.fit(rows, ["t_a", "t_b"], ["a", "b"], features=512, block_rows=block_rows, rounds=8)
    got = {(r["sample_id"], r["label"]): r["score"] for r in B.score_labels(rows, model, ["sample_id"]).collect()}
    assert len(got) == 1200
    x = dense(model, data)
    for j, label in enumerate("ab"):
        y = np.array([r[2 + j] for r in data], dtype=float)
        best, mine = exact(x, y), np.array([got[r[0], label] for r in data])
        assert np.allclose(mine, 1 / (1 + np.exp(-(x @ model.weights[:, j] + model.bias[j]))), atol=1e-4)
        assert loss(mine, y) <= loss(best, y) + 0.06 and np.corrcoef(mine, best)[0, 1] > 0.95


def test_the_same_rows_give_the_same_model(spark, rows):
    models = [B.fit(r, ["t_a", "t_b"], ["a", "b"], features=256, block_rows=100, rounds=2) for r in (rows, rows.repartition(7, "t_a"))]
    assert all(np.array_equal(p, q) for p, q in zip(models[0].arrays(), models[1].arrays()))


def test_all_training_rows_count(spark, rows):
    """The IDF and the fit see every row: a term of one row only has a weight."""
    more = rows.unionByName(spark.createDataFrame([("last", "unheard", 1, 0)], rows.schema))
    model = B.fit(more, ["t_a", "t_b"], ["a", "b"], features=1 << 14, block_rows=50, rounds=1)
    term = B.term_numbers("unheard", 1 << 14)[0]
    assert np.isclose(model.idf[term], np.log(602 / 2) + 1) and model.weights[term, 0] > 0 > model.weights[term, 1]


def test_empty_texts_and_no_training_rows(spark, rows):
    model = B.fit(rows.limit(0), ["t_a", "t_b"], ["a", "b"], features=64)
    odd = spark.createDataFrame([("x", None), ("y", ""), ("z", "!!"), ("v", "volume")], "sample_id string, model_input string")
    assert {r["score"] for r in B.score_labels(odd, model, ["sample_id"]).collect()} == {0.5}
    assert B.score_labels(odd.limit(0), model, ["sample_id"]).count() == 0


def test_term_numbers_agree_with_spark(spark):
    odd = ["Volume MOUNT_lost", "\u212aube \u0130x caf\u00e9 na\u00efve", "a-b.c\nd\t1", "", None, "\u00df\U0001f600x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    for r in df.select("t", B.hashed_terms(df["t"], 1000).alias("h")).collect():
        assert r["h"] == B.term_numbers(r["t"], 1000).tolist()


def test_model_behind_the_batch_scorer(spark, rows):
    """Scores of the plugged-in model equal those of the baseline; other label orders are refused."""
    catalog = LabelCatalog.shipped()
    both = [rows["t_a"], rows["t_b"]]
    wide = rows.select("sample_id", "model_input", *[both[i % 2].alias(f"y{i}") for i in range(len(catalog.labels))])
    model = B.fit(wide, [f"y{i}" for i in range(len(catalog.labels))], catalog.labels, features=256, rounds=1)
    shared = S.shared_model(spark, model)
    scored = S.score_batch(wide, "model_input", ["sample_id"], catalog, S.create_scorer("linear", catalog, model=shared), batch_size=7)
    got = {(r["sample_id"], r["label"]): r["score"] for r in S.explode_predictions(scored, ["sample_id"]).collect()}
    want = {(r["sample_id"], r["label"]): r["score"] for r in B.score_labels(wide, model, ["sample_id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    with pytest.raises(ValueError, match="labels differ"):
        S.create_scorer("linear", catalog, model=(shared[0], shared[1][::-1]))


def test_sparse_tfidf_counts_in_tasks_of_bounded_text(spark, monkeypatch):
    """Repeated and null ids, over many small tasks: the counts of the definition, and no sort of all counts."""
    import math
    from collections import Counter

    monkeypatch.setattr(B, "TASK_BYTES", 200)
    data = [(None if i % 9 == 0 else f"s{i % 40}", " ".join(WORDS[i % 5 : i % 11 + 1]) + " the the") for i in range(120)] + [("n", None)]
    rows = spark.createDataFrame(data, "sample_id string, model_input string")
    train = rows.where("sample_id < 's3' OR sample_id IS NULL")
    kept = [(i, t) for i, t in data if i is None or i < "s3"]
    tf = Counter((i, w) for i, t in data for w in (t or "").split())
    df = Counter(w for _, w in {(i, w) for i, t in kept for w in (t or "").split()})
    out = B.sparse_tfidf(rows, train)
    got = {(r["sample_id"], r["term"]): (r["tf"], r["weight"]) for r in out.collect()}
    assert got.keys() == tf.keys()
    assert all(got[k] == (n, pytest.approx(n * math.log((len(kept) + 1) / (df[k[1]] + 1)))) for k, n in tf.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_scores_do_not_depend_on_the_arrow_batches(spark, rows):
    """Single floats add up differently in other steps: what is scored together is the same for all batch sizes."""
    model = B.fit(rows, ["t_a", "t_b"], ["kind/a", "kind/b"])
    catalog = LabelCatalog.with_thresholds(["kind/a", "kind/b"], {"kind/a": 0.5, "kind/b": 0.5})
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    one, got = rows.coalesce(1), []
    try:
        for size in ("10000", "37"):
            spark.conf.set(key, size)
            scorer = S.create_scorer("linear", catalog, model=S.shared_model(spark, model))
            plugged = S.score_batch(one, "model_input", ["sample_id"], catalog, scorer)
            got.append((B.score_labels(one, model, ["sample_id"]).collect(), plugged.collect()))
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] and len(got[0][0]) == 1200 and len(got[0][1]) == 600
