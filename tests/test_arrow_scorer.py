import os

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusflow.plans.score import ArrowScorer, score_table
from corpusflow.session import discard, scratch_path


def test_slices_are_bounded_and_ids_kept(spark, tmp_dir):
    # functions of a test module cannot be imported by the workers, inner ones travel with the plan
    marks = os.path.join(tmp_dir, "loads")
    os.makedirs(marks)

    def load():
        with open(os.path.join(marks, f"{os.getpid()}-{len(os.listdir(marks))}"), "w"):
            pass
        return 3.0

    def logits(model, texts):
        n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
        total = pc.sum(pc.binary_length(texts)).as_py() or 0
        if len(texts) > 1 and total > 1_000:
            raise ValueError("a slice is larger than the bound")
        return np.stack([np.zeros(len(n)), n - model, -n], axis=1)

    rows = [(f"i{i}", "x" * (i * 7 % 900)) for i in range(200)] + [("long", "y" * 5_000), ("null", None), ("null", None)]
    df = spark.createDataFrame(rows, "abstract_id string, text string").repartition(12)
    scorer = ArrowScorer(logits, ["a", "b", "c"], load, batch_bytes=1_000)
    out = score_table(df, scorer, extractor=lambda c: F.array().cast("array<string>")).collect()
    assert len(out) == len(rows)
    got = {r.abstract_id: r.predicted_labels[0] for r in out}
    assert got == {k: "b" if len(t or "") > 3 else "a" for k, t in rows}
    assert abs(sum(out[0].confidence_scores.values()) - 1) < 1e-9
    pids = [f.split("-")[0] for f in os.listdir(marks)]
    assert len(pids) == len(set(pids))  # one load a worker, whatever the number of its tasks
    empty = score_table(df.where("false"), scorer, extractor=lambda c: F.array().cast("array<string>"))
    assert empty.count() == 0


def test_discard_refuses_other_folders(spark, tmp_dir):
    path = scratch_path(spark, "discarded")
    spark.range(3).write.parquet(path)
    discard(spark, path)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path).count()
    for other in (tmp_dir, "/tmp", scratch_path(spark, "x") + "/../.."):
        with pytest.raises(ValueError, match="not a scratch folder"):
            discard(spark, other)
