import pytest

from corpusflow.functions import vectors as vx


def one(spark, data, schema, fn):
    return spark.createDataFrame([(data,)], schema).select(fn("a")).first()[0]


def test_softmax(spark):
    for z, want in (([1.0, 2.0], [0.268941, 0.731059]), ([3.0, 3.0], [0.5, 0.5]), ([1000.0, 0.0], [1.0, 0.0])):
        got = one(spark, z, "a array<double>", vx.softmax)
        assert got == pytest.approx(want, abs=1e-6)


def test_argmax_tie_lowest(spark):
    assert one(spark, [3.0, 3.0], "a array<double>", vx.argmax) == 0
    assert one(spark, [1.0, 5.0, 5.0], "a array<double>", vx.argmax) == 1


def test_pad_cut_and_mask(spark):
    assert one(spark, [5, 6, 7], "a array<int>", lambda c: vx.pad_truncate(c, 5)) == [5, 6, 7, 0, 0]
    assert one(spark, [5, 6, 7], "a array<int>", lambda c: vx.attention_mask(c, 5)) == [1, 1, 1, 0, 0]
    assert one(spark, list(range(1, 8)), "a array<int>", lambda c: vx.pad_truncate(c, 5)) == [1, 2, 3, 4, 5]
    assert one(spark, list(range(1, 8)), "a array<int>", lambda c: vx.attention_mask(c, 5)) == [1] * 5


def test_confidence_map_sums_to_one(spark):
    m = one(spark, [0.3, -1.0], "a array<double>", lambda c: vx.confidence_map(["Cancer", "Non-Cancer"], vx.softmax(c)))
    assert set(m) == {"Cancer", "Non-Cancer"} and sum(m.values()) == pytest.approx(1.0)
