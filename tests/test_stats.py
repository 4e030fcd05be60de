import pytest

from corpusflow.operators.stats import corpus_stats, label_counts


def test_stats_by_scope(spark):
    rows = [("a b c", "X", "train"), ("a b", "Y", "train"), ("a", "X", "test"), ("a b c d", "X", "val")]
    df = spark.createDataFrame(rows, "text string, label string, split string")
    s = {r.scope: r for r in corpus_stats(df, scopes=["train", "val", "test"]).collect()}
    g = s["global"]
    assert g.num_samples == 4 and g.min_len_words == 1 and g.max_len_words == 4
    assert g.avg_len_words == pytest.approx(2.5) and g.avg_len_chars == pytest.approx((5 + 3 + 1 + 7) / 4)
    assert list(g.label_counts.items()) == [("X", 3), ("Y", 1)]  # most frequent first
    assert s["train"].num_samples == 2 and dict(s["train"].label_counts) == {"X": 1, "Y": 1}
    assert list(s["train"].label_counts) == ["X", "Y"]  # ties by label


def test_empty_scope_gives_nulls(spark):
    df = spark.createDataFrame([("a b", "X", "train")], "text string, label string, split string")
    s = {r.scope: r for r in corpus_stats(df, scopes=["train", "val", "test"]).collect()}
    assert s["val"].num_samples is None and s["val"].avg_len_words is None


def test_label_counts_long(spark):
    df = spark.createDataFrame([("X", "train"), ("X", "test"), ("Y", "test")], "label string, split string")
    got = {(r.scope, r.label): r.n for r in label_counts(df).collect()}
    assert got == {("global", "X"): 2, ("global", "Y"): 1, ("train", "X"): 1, ("test", "X"): 1, ("test", "Y"): 1}


def test_missing_label_is_a_sample_but_no_entry(spark):
    d = spark.createDataFrame([("a b", "x", "train"), ("c", None, "train"), ("d", "x", "val")], "text string, label string, split string")
    got = {r.scope: r for r in corpus_stats(d).collect()}
    assert got["global"].num_samples == 3 and got["global"].label_counts == {"x": 2}
