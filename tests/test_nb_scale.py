"""What naive Bayes scoring and grouped evaluation move and write, and streams over tables that are folders."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.models import nb as nbmod
from corpusflow.models.nb import fit_naive_bayes
from corpusflow.operators.evaluate import confusion_long, evaluate


def _rows(spark):
    often = ["a", "b", "c", "d"]
    rows = [(i % 2, [often[(i + j) % 4] for j in range(40)] + [f"rare{i}", f"rare{i % 7}"]) for i in range(60)]
    return spark.createDataFrame(rows, "label_id int, tokens array<string>")


def test_only_cold_words_are_written_for_a_large_vocabulary(spark, monkeypatch):
    model = fit_naive_bayes(_rows(spark), "tokens", "label_id", ["0", "1"])
    rows = spark.createDataFrame(
        [(1, ["x1"], ["a", "b", "a", "rare30", "rare30", "unseen"]), (1, ["x1"], ["a"]), (2, [], []), (3, ["y"], None), (4, None, ["rare31", "unseen"])],
        "i int, names array<string>, tokens array<string>")
    written = []
    real = nbmod.materialize
    monkeypatch.setattr(nbmod, "materialize", lambda df, name="table": written.append(real(df, name)) or written[-1])
    want = sorted((r.i, r.names or [], *np.round(r.logits, 9)) for r in model.logits(rows, carry=["i", "names"]).collect())
    assert not written
    got = sorted((r.i, r.names or [], *np.round(r.logits, 9)) for r in model.logits(rows, carry=["i", "names"], max_broadcast=0, hot_words=8).collect())
    assert got == want and len(got) == 5
    # 5 rows of sums; of the words only (rare30, unseen) and (rare31, unseen)
    assert written[0].count() == 5 + 4


def test_hot_words_fit_their_bytes(spark):
    model = fit_naive_bayes(_rows(spark), "tokens", "label_id", ["0", "1"])
    assert {r.token for r in model.hot_words(4 * 65).collect()} == {"a", "b", "c", "d"}
    assert model.hot_words(0).count() == 0 and model.hot_words(1 << 20).count() == model.vocab_size == 64


def test_fit_counts_are_shuffled_once_per_token(spark, monkeypatch):
    written = []
    real = nbmod.materialize
    monkeypatch.setattr(nbmod, "materialize", lambda df, name="table": written.append(real(df, name)) or written[-1])
    model = fit_naive_bayes(_rows(spark), "tokens", "label_id", ["0", "1"])
    assert len(written) == 1 and written[0].count() == 64
    assert "Exchange" not in model.params._jdf.queryExecution().toString()


def test_grouped_metrics_evaluate_predictions_once(spark):
    def run(scored):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return scored.mapInArrow(count, scored.schema), seen

    scored = spark.createDataFrame([(g, i % 2, i % 3 % 2) for g in "xy" for i in range(30)], "split string, label_id int, pred_id int")
    df, seen = run(scored)
    assert {r.split: r.support for r in evaluate(df, group_cols=["split"], classes=[0, 1]).collect()} == {"x": 30, "y": 30}
    assert seen.value == 60
    df, seen = run(scored)
    assert confusion_long(df, group_cols=["split"], classes=[0, 1]).agg(F.sum("n")).first()[0] == 60
    assert seen.value == 60


def test_stream_score_reads_a_table_of_several_files(spark, tmp_dir):
    from corpusflow.plans import catalog

    words = ["in the house of the rising", "a reaction of note", "nothing here"]
    docs = spark.createDataFrame([(i, f"{words[i % 3]} {i}") for i in range(12)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_dir}/labels.parquet")
    want = sorted(tuple(r) for r in catalog.QUERIES["enriched_predictions"](spark, tmp_dir).collect())
    got = sorted(tuple(r) for r in catalog.QUERIES["stream_score"](spark, tmp_dir).collect())
    assert got == want and len(got) == 12

    # the same table as one file, beside another one
    import shutil

    one = f"{tmp_dir}/one"
    docs.coalesce(1).write.parquet(f"{tmp_dir}/single")
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(f"{one}/labels.parquet")
    shutil.copy(next(p for p in spark.read.parquet(f"{tmp_dir}/single").inputFiles()).removeprefix("file://"), f"{one}/documents.parquet")
    shutil.copy(f"{one}/documents.parquet", f"{one}/pages.parquet")
    assert sorted(tuple(r) for r in catalog.QUERIES["stream_score"](spark, one).collect()) == want


def test_a_batch_of_one_row_group_is_spread(spark, tmp_dir):
    from corpusflow.plans.score import PandasScorer
    from corpusflow.streaming.score_stream import spread_batch, stream_score

    n = spark.sparkContext.defaultParallelism
    one = spark.range(40 * n).repartition(1).union(spark.range(0).repartition(4 * n))
    got = spread_batch(one)
    assert max(r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= 2 * 40
    even = spark.range(0, 40 * n, 1, n)
    assert spread_batch(even) is even and spread_batch(spark.range(0)).count() == 0

    one = spark.createDataFrame([(str(i), "lung cancer " * 40 + str(i)) for i in range(40 * n)], "abstract_id string, text string")
    one.coalesce(1).write.parquet(f"{tmp_dir}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")  # more splits than cores
    try:
        scorer = PandasScorer(lambda texts: [[float(len(t)), 0.0] for t in texts], ["long", "short"])
        stream_score(spark, f"{tmp_dir}/in", scorer, f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.select("abstract_id").distinct().count() == out.count() == 40 * n
    assert len(out.inputFiles()) > 1  # one task would have written one file
