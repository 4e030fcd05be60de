import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.text import word_tokens
from corpusflow.models import nb as nbmod
from corpusflow.models.centroid import fit_centroids
from corpusflow.models.linear import fit_text_lr, predict_text, select_on_validation, trainable_parameters
from corpusflow.models.nb import NaiveBayesModel, fit_naive_bayes
from corpusflow.operators import encode as enc
from corpusflow.operators.evaluate import evaluate
from corpusflow.operators.labels import label_list
from corpusflow.plans.catalog_models import labelled
from corpusflow.plans.score import NaiveBayesScorer, PandasScorer, score_table, score_text
from paths import SF_MID


@pytest.fixture(scope="module")
def lab(spark):
    return labelled(spark, SF_MID)


@pytest.fixture(scope="module")
def nb(spark, lab):
    p, dim = lab
    tr = p.where(F.col("split") == "train").select(word_tokens("text").alias("tokens"), "label_id")
    return fit_naive_bayes(tr, "tokens", "label_id", label_list(dim))


def test_nb_beats_majority_on_held_out(spark, lab, nb):
    p, _ = lab
    held = p.where(F.col("split") != "train")
    z = nb.logits(held.select("doc_id", "label_id", word_tokens("text").alias("tokens")), "tokens",
                  carry=["doc_id", "label_id"])
    pred = z.select("label_id", (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("pred_id"))
    acc = evaluate(pred, classes=[0, 1]).first().accuracy
    majority = held.groupBy("label_id").count().agg(F.max("count")).first()[0] / held.count()
    assert acc >= majority


def test_nb_shuffle_join_equals_broadcast(spark, lab, nb, monkeypatch):
    p, _ = lab
    rows = p.select("doc_id", word_tokens("text").alias("tokens"))
    a = {r.doc_id: r.logits for r in nb.logits(rows, "tokens", carry=["doc_id"]).collect()}
    monkeypatch.setattr(nbmod, "MAX_BROADCAST_BYTES", 0)
    b = {r.doc_id: r.logits for r in nb.logits(rows, "tokens", carry=["doc_id"]).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_nb_duplicate_ids_stay_separate(spark, nb):
    df = spark.createDataFrame([("x", ["ouen", "the"]), ("x", ["the"]), ("x", [])], "doc_id string, tokens array<string>")
    z = nb.logits(df, "tokens", carry=["doc_id"]).collect()
    assert len(z) == 3 and any(np.allclose(r.logits, nb.log_priors) for r in z)


def test_nb_save_load(spark, nb, tmp_dir):
    nb.save(os.path.join(tmp_dir, "nb"))
    m = NaiveBayesModel.load(spark, os.path.join(tmp_dir, "nb"))
    assert m.labels == nb.labels and m.vocab_size == nb.vocab_size and m.params.count() == nb.params.count()


def test_score_table_and_text(spark, nb):
    s = score_text(spark, "This study focuses on lung cancer treatment.", NaiveBayesScorer(nb, clean=True)).first()
    assert s.abstract_id == "manual_input" and s.extracted_diseases == ["Lung Cancer"]
    assert sum(s.confidence_scores.values()) == pytest.approx(1.0) and s.predicted_labels[0] in nb.labels


def test_pandas_scorer(spark):
    df = spark.createDataFrame([("a", "short"), ("b", "a much longer text here")], "abstract_id string, text string")

    def predict(texts):
        return np.stack([np.zeros(len(texts)), texts.str.len().to_numpy() / 10.0], axis=1)

    out = {r.abstract_id: r for r in score_table(df, PandasScorer(predict, ["Short", "Long"])).collect()}
    assert out["b"].predicted_labels == ["Long"] and out["a"].confidence_scores["Long"] > 0.5


def test_encode_equals_plain_lookup(spark, lab):
    p, _ = lab
    rows = p.select("doc_id", word_tokens("text").alias("tokens"))
    for size in (500, None):
        vocab = enc.build_vocab(rows, "tokens", size)
        ids = {r.token: r.token_id for r in vocab.collect()}
        assert sorted(ids.values()) == list(range(2, 2 + len(ids))) and (size is None or len(ids) == size)
        got = {r.doc_id: (r.input_ids, r.attention_mask) for r in enc.encode(rows, "tokens", vocab, 12).collect()}
        for r in rows.collect():
            want = [ids.get(t, 1) for t in r.tokens[:12]]
            assert got[r.doc_id] == (want + [0] * (12 - len(want)), [1] * len(want) + [0] * (12 - len(want)))


def test_encode_null_and_empty_tokens(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "i int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2)], "token string, token_id int")
    got = {r.i: (r.input_ids, r.attention_mask) for r in enc.encode(d, "tokens", vocab, 3).collect()}
    assert got == {1: ([2, 1, 0], [1, 1, 0]), 2: ([0] * 3, [0] * 3), 3: ([0] * 3, [0] * 3)}


def test_fits_use_several_tasks(spark):
    from corpusflow.session import spread

    d = spark.range(100).repartition(1)
    assert spread(d).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_spark_ml_scorer(spark, lab):
    from corpusflow.models.linear import fit_text_lr
    from corpusflow.plans.score import SparkMLScorer, score_table

    p, _ = lab
    model = fit_text_lr(p, "text", "label_id", num_features=1 << 10, reg_param=0.1, max_iter=5)
    out = score_table(p.select(p["doc_id"].alias("abstract_id"), "text"), SparkMLScorer(model, ["0", "1"])).collect()
    assert len(out) == p.count() and all(abs(sum(r.confidence_scores.values()) - 1) < 1e-9 for r in out)


def test_centroid_model(spark):
    e = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    m = fit_centroids(e, "embedding", "label")
    assert len(m.label_ids) == 10 and m.num_params == 640
    pred = m.predict(e).select(F.col("label").alias("label_id"), "pred_id")
    assert evaluate(pred).first().accuracy > 0.1


def test_linear_text_and_selection(spark, lab):
    p, _ = lab
    train, val = p.where(F.col("split") == "train"), p.where(F.col("split") == "val")
    model = fit_text_lr(train, "text", "label_id", num_features=1 << 12, reg_param=0.1, max_iter=20)
    out = predict_text(model, val)
    assert out.count() == val.count()
    assert trainable_parameters(model)["input_width"] == 1 << 12
    grid = [{"reg_param": r, "num_features": 1 << 12, "max_iter": 10} for r in (0.0, 1.0)]
    sel = select_on_validation(train, val, grid, lambda d, **kw: fit_text_lr(d, "text", "label_id", **kw),
                               lambda m, d: predict_text(m, d))
    assert sel.best_params in grid and sel.table.count() == 2
