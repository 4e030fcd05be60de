import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators.evaluate import class_report, confusion_long, confusion_sparse, custom_metrics, evaluate, report_text
from corpusflow.operators.select import best_by


def preds(spark, pairs, groups=None):
    rows = [(g if groups else 0, t, p) for g, (t, p) in zip(groups or [0] * len(pairs), pairs)]
    return spark.createDataFrame(rows, "g int, label_id int, pred_id int")


def test_binary_metrics(spark):
    df = preds(spark, [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)])
    m = evaluate(df, classes=[0, 1]).first()
    assert m.accuracy == pytest.approx(0.6)
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 1, 2)
    assert m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(2 / 3) and m.f1 == pytest.approx(2 / 3)
    assert m.confusion_matrix == [[1, 1], [1, 2]]


def test_zero_denominator_and_not_two_by_two(spark):
    m = evaluate(preds(spark, [(1, 0), (0, 0)])).first()
    assert m.precision == 0.0 and m.f1 == 0.0
    m3 = evaluate(preds(spark, [(0, 0), (1, 2), (2, 2)])).first()
    assert m3.tn is None and m3.tp is None and len(m3.confusion_matrix) == 3
    one = evaluate(preds(spark, [(0, 0), (0, 0)])).first()
    assert one.tn is None and one.confusion_matrix == [[2]]


def test_grid_includes_zeros_and_total(spark):
    df = preds(spark, [(0, 0), (2, 2), (2, 0)])
    long = confusion_long(df)
    assert long.count() == 4 and long.agg(F.sum("n")).first()[0] == 3


def test_report_matches_hand_computation(spark):
    df = preds(spark, [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)])
    r = {x["class"]: x for x in class_report(confusion_long(df), names={0: "Cancer", 1: "Non-Cancer"}).collect()}
    assert r["Cancer"].precision == pytest.approx(0.5) and r["Cancer"].support == 2
    assert r["accuracy"].f1 == pytest.approx(0.6) and r["accuracy"].support == 5
    assert r["macro avg"].recall == pytest.approx((0.5 + 2 / 3) / 2)
    assert r["weighted avg"].f1 == pytest.approx((0.5 * 2 + 2 / 3 * 3) / 5)
    text = report_text(class_report(confusion_long(df), names={0: "Cancer", 1: "Non-Cancer"})).first()[0]
    assert "Non-Cancer" in text and "weighted avg" in text


def test_grouped_and_extra_metric(spark):
    df = preds(spark, [(0, 0), (1, 1), (1, 0), (0, 0)], groups=[1, 1, 2, 2])
    m = {r.g: r for r in evaluate(df, group_cols=["g"], classes=[0, 1],
                                  extra={"n_pos_pred": F.sum("pred_id")}).collect()}
    assert m[1].accuracy == 1.0 and m[2].accuracy == 0.5 and m[1].n_pos_pred == 1


def test_best_by(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "k int, f1 double")
    assert best_by(df, "f1", tie_cols=["k"]).first().k == 2
    assert sorted(r.k for r in best_by(df, "f1", tie_cols=["k"], keep=2).collect()) == [2, 3]


def test_ungrouped_extra_metric_has_no_cross_join(spark):
    df = preds(spark, [(0, 0), (1, 1), (1, 0), (0, 1)])
    out = evaluate(df, classes=[0, 1], extra={"n_pos_pred": F.sum("pred_id"), "worst": F.max("label_id")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    m = out.first()
    assert m.accuracy == 0.5 and m.n_pos_pred == 2 and m.worst == 1 and m.confusion_matrix == [[1, 1], [1, 1]]


def test_report_text_is_in_class_order(spark):
    rows = [(i % 12, (i * 5) % 12) for i in range(60)]
    long = confusion_long(spark.createDataFrame(rows, "label_id int, pred_id int"))
    text = report_text(class_report(long)).first()[0]
    assert [x.split()[0] for x in text.split("\n")[1:13]] == [str(i) for i in range(12)]


def test_fifty_thousand_classes_stay_sparse(spark):
    n = 50_000
    df = spark.range(n).select(F.col("id").cast("int").alias("label_id"), (F.col("id") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).cast("int").alias("pred_id"))
    m = evaluate(df).first()
    assert m.accuracy == pytest.approx(0.75) and m.confusion_matrix is None and m.support == n and m.tn is None
    pairs = confusion_sparse(df)
    assert pairs.count() == n
    r = {x["class"]: x for x in class_report(pairs).where("class_id IS NULL").collect()}
    assert r["accuracy"].f1 == pytest.approx(0.75) and r["weighted avg"].recall == pytest.approx(0.75)
    with pytest.raises(ValueError, match="dense matrix"):
        evaluate(df, dense=True)


def test_dense_on_request(spark):
    df = preds(spark, [(0, 0), (1, 2), (2, 2), (None, 1), (1, None)])
    assert evaluate(df, dense=False).first().confusion_matrix is None
    assert evaluate(df, dense=True).first().confusion_matrix == [[1, 0, 0], [0, 0, 1], [0, 0, 1]]
    assert evaluate(df).first().support == 3  # pairs without a truth or a prediction count for nothing


def test_custom_metrics_by_group(spark):
    df = preds(spark, [(0, 0), (1, 1), (1, 0), (0, 0), (2, 2), (2, 1)], groups=[1, 1, 1, 2, 2, 2])

    def macro_recall(t, p, n):
        return float(np.mean([n[(t == c) & (p == c)].sum() / n[t == c].sum() for c in np.unique(t)]))

    got = {r.g: r.x for r in custom_metrics(df, macro_recall, "x", group_cols=["g"]).collect()}
    assert got == {1: pytest.approx(0.75), 2: pytest.approx(0.75)}
    assert custom_metrics(df, lambda t, p, n: n.sum(), "rows").first().rows == 6
    assert custom_metrics(df.where("false"), macro_recall, "x", group_cols=["g"]).count() == 0
