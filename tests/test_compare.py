import json

import pytest

from corpusflow.operators.compare import compare, core_table, extract_core, flat_cm_stats


def core(spark, obj):
    df = spark.createDataFrame([(json.dumps(obj),)], "j string")
    return df.select(extract_core("j").alias("c")).first().c


def test_present_null_wins_over_later_alias(spark):
    assert core(spark, {"accuracy": 0.9, "f1": None, "f1_score": 0.5}).f1 is None
    assert core(spark, {"accuracy": 0.9, "eval_f1": 0.7}).f1 == 0.7


def test_wrapped_metrics_and_report(spark):
    c = core(spark, {"metrics": {"eval_accuracy": 0.8, "eval_confusion_matrix": [[1, 2], [3, 4]]}, "epoch": 3})
    assert c.accuracy == 0.8 and c.confusion_matrix == [[1, 2], [3, 4]]
    assert core(spark, {"accuracy": 1.0, "report": "txt"}).classification_report == "txt"


def test_flat_cm(spark):
    df = spark.createDataFrame([([[1, 2], [3, 4]],), ([[1]],), (None,)], "cm array<array<bigint>>")
    got = [r[0] for r in df.select(flat_cm_stats("cm")).collect()]
    assert tuple(got[0]) == (1, 2, 3, 4) and got[1] is None and got[2] is None


def test_compare_deltas_and_missing(spark):
    recs = [("base", json.dumps({"accuracy": 0.96, "f1_score": 0.9, "confusion_matrix": [[10, 1], [1, 10]]})),
            ("lora", json.dumps({"accuracy": 0.93, "f1": 0.8, "confusion_matrix": [[9, 2], [1, 10]]})),
            ("bad", json.dumps({"f1": 0.1}))]
    c = core_table(spark.createDataFrame(recs, "model string, json string"), keep=["model"])
    r = compare(c, "base", "lora").first()
    assert round(r.delta_accuracy, 2) == -0.03 and r.delta_accuracy_text == "-0.0300"
    assert r.delta_fp == 1 and r.delta_fn == 0 and r.missing == []
    b = compare(c, "base", "bad").first()
    assert b.delta_accuracy is None and b.missing == ["accuracy", "confusion_matrix"]


def test_deeply_wrapped_record(spark):
    record = '{"accuracy": 0.5, "f1": 0.25, "confusion_matrix": [[1, 0], [0, 1]]}'
    for _ in range(6):
        record = '{"metrics": ' + record + "}"
    row = core_table(spark.createDataFrame([("m", record)], "model string, json string"), keep=["model"]).first()
    assert (row.accuracy, row.f1, row.tp) == (0.5, 0.25, 1)


def test_two_records_of_a_model_are_refused(spark):
    rows = [("a", '{"accuracy": 1}'), ("a", '{"accuracy": 0}'), ("b", '{"accuracy": 1}')]
    core = core_table(spark.createDataFrame(rows, "model string, json string"), keep=["model"])
    with pytest.raises(Exception, match="several metric records"):
        compare(core, "a", "b").collect()


def test_comparison_holds_matrices_and_reports(spark):
    rows = [(m, '{"accuracy": 1, "f1": 1, "confusion_matrix": [[1,0],[0,2]], "report": "r"}') for m in "ab"]
    row = compare(core_table(spark.createDataFrame(rows, "model string, json string"), keep=["model"]), "a", "b").first()
    assert row.base_confusion_matrix == row.cand_confusion_matrix == [[1, 0], [0, 2]] and row.cand_classification_report == "r"
