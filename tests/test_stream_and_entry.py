import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from corpusflow.plans import catalog
from paths import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "abstract_id" in df.columns


def test_catalogue_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 40


def test_stream_equals_batch(spark):
    s = {tuple(r) for r in catalog.QUERIES["stream_score"](spark, SF_SMALL).collect()}
    b = {tuple(r) for r in catalog.QUERIES["enriched_predictions"](spark, SF_SMALL).collect()}
    assert s == b and len(s) > 0


def test_stream_csv_default_ids(spark):
    from corpusflow.plans.catalog_models import stream_csv_predictions

    out = stream_csv_predictions(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert out.count() == docs
    assert out.where(~F.col("abstract_id").rlike(r"^part-.*csv#id_\d+$")).count() == 0
    assert out.select("abstract_id").distinct().count() == docs  # unique over files and batches
    assert out.where(F.size("extracted_diseases") > 0).count() > 0  # the text column arrived


def test_csv_stream_bounded_batches(spark, tmp_dir):
    from corpusflow.plans.score import PandasScorer
    from corpusflow.streaming.score_stream import stream_score_csv

    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for k, n in (("a", 4), ("b", 2), ("c", 3)):
        with open(os.path.join(src, f"{k}.csv"), "w") as f:
            f.write("text\n" + "".join(f"{k} lung cancer {i}\n" for i in range(n)))
    scorer = PandasScorer(lambda texts: [[float(len(t)), 0.0] for t in texts], ["long", "short"])
    q = stream_score_csv(spark, src, scorer, tmp_dir + "/out", tmp_dir + "/ckpt", max_files=1)
    q.awaitTermination()
    batches = sorted(d for d in os.listdir(tmp_dir + "/out") if d.startswith("batch="))
    assert len(batches) == 3  # one file per micro-batch
    out = spark.read.json(tmp_dir + "/out")
    assert out.count() == 9
    assert sorted(r.abstract_id for r in out.collect()) == sorted(f"{k}.csv#id_{i}" for k, n in (("a", 4), ("b", 2), ("c", 3)) for i in range(n))
