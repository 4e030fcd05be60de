import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.models.gradient import Candidate, Head, epoch_metrics, fit_epochs, fit_head, hashed_counts, select_epoch


def _plain(x, y, cand, steps):
    w = np.zeros(x.shape[1] + 1)
    a = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / len(x)
        g[:-1] += cand.l2 * w[:-1]
        w = w - cand.rate * g
    return w


def _rows(spark, n=120, dims=7, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, "val" if i % 4 == 0 else "train", int(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, split string, label_id int, features array<double>").repartition(5).cache(), x, y


def test_steps_equal_numpy_for_every_candidate_and_epoch(spark):
    df, x, y = _rows(spark)
    grid = [Candidate(0.5, 0.0), Candidate(2.0, 0.1)]
    heads = fit_epochs(df, grid, epochs=2, steps=4)
    for cand, epochs in zip(grid, heads, strict=True):
        for e, h in enumerate(epochs, 1):
            assert [*h.weights, h.bias] == pytest.approx(_plain(x, y, cand, 4 * e), abs=1e-9)


def test_probability_and_selection(spark):
    df, x, y = _rows(spark)
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    heads = fit_epochs(train, [Candidate(1.0), Candidate(0.001)], epochs=2, steps=3)
    best, m = select_epoch(val, heads)
    rows = {(r.candidate, r.epoch): r for r in m.collect()}
    assert sum(r.chosen for r in rows.values()) == 1
    top = max(rows.values(), key=lambda r: (r.f1, -r.candidate, -r.epoch))
    assert top.chosen and heads[top.candidate][top.epoch - 1] == best
    at = np.array([i % 4 == 0 for i in range(len(x))])
    pred = (x[at] @ np.array(best.weights) + best.bias > 0).astype(int)
    assert top.accuracy == pytest.approx((pred == y[at]).mean())
    p = val.select("id", best.probability("features").alias("p")).first()
    assert p.p == pytest.approx(1 / (1 + math.exp(-(x[p.id] @ np.array(best.weights) + best.bias))))
    assert epoch_metrics(df, heads, group_cols=["split"]).count() == 8


def test_hashed_counts(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "Ü"]), (2, []), (3, None), (1, ["a", "b", "a", "Ü"])], "id int, tokens array<string>")
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16
    want = np.zeros(16)
    for w, n in (("a", 2), ("b", 1), ("Ü", 1)):
        want[bucket(w)] += n
    want = np.log1p(want)
    rows = hashed_counts(df, "tokens", 16, ["id"]).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.features == pytest.approx(want / np.linalg.norm(want) if r.id == 1 else np.zeros(16))


def test_refusals(spark):
    df, *_ = _rows(spark)
    with pytest.raises(ValueError, match="no training rows"):
        fit_head(df.where("id < 0"))
    with pytest.raises(ValueError, match="differ in length"):
        fit_head(df.withColumn("features", F.when(F.col("id") > 3, F.col("features")).otherwise(F.array(F.lit(1.0)))))
    assert Head((1.0,), 0.0).weights == (1.0,)
