"""Learned operators (3, 4, 10): held-out accuracy, and defined results on edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import language_id, quality, toxicity
from corpusflow.llm.common import fold

SF = "/root/testdata/sf0.1"


def _labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_fold_is_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_quality_held_out(spark):
    out = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), _labels(spark)).join(_labels(spark), "doc_id").where("held_out")
    right = {(r["quality"], r["predicted"]): r["count"] for r in out.groupBy("quality", "predicted").count().collect()}
    good, bad = (sum(n for (q, _), n in right.items() if q == x) for x in (1, 0))
    assert right[1, 1] / good > 0.98 and right[0, 0] / bad > 0.85


def test_nn_pu_finds_positives_without_negative_labels():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (400, 3))
    unl = np.concatenate([rng.normal(1.5, 1, (600, 3)), rng.normal(-1.5, 1, (400, 3))])
    w, b = quality.nn_pu(pos, unl, 0.6)
    assert (pos @ w + b > 0).mean() > 0.9 and (neg @ w + b < 0).mean() > 0.9
    assert 0.45 < quality.estimate_prior(pos, unl) < 0.75


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = toxicity.classify(docs, _labels(spark)).join(_labels(spark), "doc_id").where("held_out")
    right = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    toxic, clean = (sum(n for (q, _), n in right.items() if q == x) for x in (1, 0))
    assert right[1, 1] / toxic > 0.55 and right[0, 0] / clean > 0.98


def test_toxicity_misspelling_shares_grams():
    clean = [f"plain words number {i} go here and there".encode() for i in range(120)]
    toxic = [f"plain words number {i} you stupidhead there".encode() for i in range(120)]
    bucket, bias = toxicity.train(clean + toxic, np.array([0] * 120 + [1] * 120))
    model = toxicity.ToxicityModel(bucket, bias, 0.0)

    def one(text):
        b = np.frombuffer(text.encode(), np.uint8)
        return model.score(b, np.array([0, len(b)]))[0]

    assert one("plain words you stupidheadd there") > one("plain words you friendly there")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.99


def test_classifiers_on_edge_rows(spark, edge, nothing):
    labels = _labels(spark)
    n = edge.count()
    for out in (quality.classify(edge, labels), toxicity.classify(edge, labels)):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(edge, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.classify(edge, none).collect()} == {0.0}
    for f in (quality.classify, toxicity.classify):
        assert f(nothing, labels).count() == 0
    conflicting = spark.createDataFrame([(4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(edge, conflicting).count() == n and toxicity.classify(edge, conflicting).count() == n


def test_language_edges(spark, edge, nothing):
    rows = language_id.identify(edge).collect()
    assert len(rows) == edge.count()
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert got[1] == got[2] == got[3] == "und" and got[4] in {"en", "fr", "de"} and got[11] != "und"
    digits = spark.createDataFrame([(1, "123 !!", "en"), (2, "数", "zh"), (3, "x", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(digits).collect()}
    assert got[1] == "und" and got[2] != "und"
    assert language_id.identify(nothing).count() == 0


@pytest.mark.parametrize("name", ["lang", "source", "doc_id"])
def test_language_does_not_read_other_columns(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = docs.select("doc_id", "text", "lang")
    model = language_id.fit(d.where(fold(F.col("doc_id"), 4) != 2))
    a = {r["doc_id"]: r["score"] for r in language_id.predict(d, model).collect()}
    b = {r["doc_id"]: r["score"] for r in language_id.predict(docs.withColumn("lang", F.lit("xx")).select("doc_id", "text", "lang"), model).collect()}
    assert a == b


def _one_by_one(score, rows):
    out = {}
    for r in rows:
        b = np.frombuffer((r["text"] or "").encode(), np.uint8)
        out[r["doc_id"]] = score(b, np.array([0, len(b)]))
    return out


def test_rows_are_scored_as_each_text_alone(spark, small):
    """Neither the rows that share a batch nor its spans change a score."""
    labels, rows = _labels(spark), small.collect()
    q = quality.fit(small.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label")))
    t = toxicity.fit(small.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("label")))
    for model, module, alone in (
        (q, quality, lambda b, o: float(q.score(quality.statistics(b, o))[0])),
        (t, toxicity, lambda b, o: float(t.score(b, o)[0])),
    ):
        got = {r["doc_id"]: r["score"] for r in module.score(small.select("doc_id", "text").repartition(3), model).collect()}
        assert got == pytest.approx(_one_by_one(alone, rows), abs=1e-6)


def test_language_scores_equal_a_plain_kernel(spark, small):
    """Presence of n-grams as Python sets, the kernel and the ridge scores by their formulas."""
    d = small.select("doc_id", "text", "lang")
    model = language_id.fit(d.where(fold(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: r for r in language_id.predict(d, model).collect()}
    for r in small.limit(40).collect():
        folded = bytearray(language_id._FOLDED[np.frombuffer(r["text"].encode(), np.uint8)].tobytes())
        raw = bytes(folded)
        for i in range(1, len(raw)):  # capital accented letters
            if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
                folded[i] += 0x20
        held, base = set(), 0
        for n, (bits, _) in language_id.BLEND.items():
            for i in range(len(folded) - n + 1):
                code = int.from_bytes(folded[i : i + n], "big")
                held.add(base + (code if n == 1 else (code * 0x9E3779B1 % (1 << 32)) >> (32 - bits)))
            base += 1 << bits
        w = language_id.weights()
        kernel = sum(model.landmarks[f].astype(float) for f in held) / np.sqrt(sum(float(w[f]) for f in held))
        z = kernel @ model.ridge.astype(float)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[int(z.argmax())]
        assert got[r["doc_id"]]["score"] == pytest.approx(float(np.clip(z.max(), 0, 1)), abs=1e-3)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id and one text with most of the rows: the samples stay small, and every language is learned."""
    rows = [(1, "the same text again", "en")] * 300 + [(1, f"one id and text number {i}", "en") for i in range(300)]
    rows += [(7, "ein Satz der Zeit", "de")] * 200 + [(8, "la phrase du temps", "fr"), (12, "una frase", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d.where("lang IS NOT NULL"), per_language=5)
    assert model.languages == ["de", "en", "fr"]
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.fit(d.where("lang IS NOT NULL"))
    from corpusflow.llm.common import bounded_sample

    assert bounded_sample(d, 1_000, 1).count() == 304 and bounded_sample(d, 10, 1).count() == 10


def test_prior_is_estimated_without_negative_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known = _labels(spark).select("doc_id", F.col("quality").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    both, positives = quality.fit(docs, known), quality.fit(docs, known.where("label = 1"))
    assert abs(positives.prior - share) < 0.05 and both.prior == positives.prior
