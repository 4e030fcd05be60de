import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.operators.split import seeded_key, seeded_rank, split_exact, split_sizes


def _oracle(df, id_col, tr=0.8, vr=0.1, seed=42):
    n = df.count()
    n_tr, n_v, _ = split_sizes(n, tr, vr)
    w = Window.orderBy(seeded_key(id_col, seed), id_col)
    r = df.withColumn("pos", F.row_number().over(w) - 1)
    lab = F.when(F.col("pos") < n_tr, "train").when(F.col("pos") < n_tr + n_v, "val").otherwise("test")
    return {(row[0], row[1]) for row in r.select(id_col, lab).collect()}


@pytest.mark.parametrize("n", [1, 2, 7, 10, 465, 1000])
def test_sizes_and_oracle(spark, n):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    s = split_exact(df, "doc_id")
    got = {(r[0], r[1]) for r in s.select("doc_id", "split").collect()}
    assert got == _oracle(df, "doc_id")
    counts = {r[0]: r[1] for r in s.groupBy("split").count().collect()}
    n_tr, n_v, n_te = split_sizes(n, 0.8, 0.1)
    assert (counts.get("train", 0), counts.get("val", 0), counts.get("test", 0)) == (n_tr, n_v, n_te)


def test_465_gives_372_46_47():
    assert split_sizes(465, 0.8, 0.1) == (372, 46, 47)


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = {tuple(r) for r in split_exact(df, "doc_id").select("doc_id", "split").collect()}
    b = {tuple(r) for r in split_exact(df.repartition(13).orderBy(F.rand(1)), "doc_id").select("doc_id", "split").collect()}
    assert a == b


def test_small_buckets_same_result(spark):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    a = {tuple(r) for r in split_exact(df, "doc_id").select("doc_id", "split").collect()}
    b = {tuple(r) for r in split_exact(df, "doc_id", bucket_digits=1).select("doc_id", "split").collect()}
    assert a == b


def test_duplicated_id_on_a_cut_is_split_exactly(spark):
    # one id holding a third of the rows: its copies straddle a cut and must be divided exactly
    hot = spark.range(150).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("copy"))
    rest = spark.range(300).select((F.col("id") + 1000).alias("doc_id"), F.lit(-1).cast("long").alias("copy"))
    df = hot.unionByName(rest)
    s = split_exact(df, "doc_id")
    counts = {r[0]: r[1] for r in s.groupBy("split").count().collect()}
    assert (counts["train"], counts["val"], counts["test"]) == split_sizes(450, 0.8, 0.1)
    assert s.count() == 450


def test_bad_ratios(spark):
    df = spark.range(3)
    for tr, vr in ((0.9, 0.2), (0, 0.1), (0.5, 1.0)):
        with pytest.raises(ValueError):
            split_exact(df, "id", tr, vr)


def test_seeded_rank_matches_row_number(spark):
    df = spark.range(800).withColumnRenamed("id", "doc_id")
    got = {tuple(r) for r in seeded_rank(df, "doc_id").select("doc_id", "pos").collect()}
    w = Window.orderBy(seeded_key("doc_id"), "doc_id")
    want = {tuple(r) for r in df.select("doc_id", (F.row_number().over(w) - 1).alias("pos")).collect()}
    assert got == want


def test_seeded_rank_with_a_hot_duplicated_id(spark):
    hot = spark.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("copy")).repartition(5)
    rest = spark.range(300).select((F.col("id") + 1000).alias("doc_id"), F.lit(-1).cast("long").alias("copy"))
    df = hot.unionByName(rest)
    r = seeded_rank(df, "doc_id")
    pos = sorted(x.pos for x in r.collect())
    assert pos == list(range(500))  # a permutation: every position exactly once
    w = Window.orderBy(seeded_key("doc_id"), "doc_id")
    first = {x.doc_id: x.p for x in df.groupBy("doc_id").count().select(
        "doc_id", (F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("p")).collect()}
    got = r.groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).collect()
    for g in got:
        lo = first[g.doc_id] or 0
        assert (g.lo, g.hi) == (lo, lo + g.n - 1)  # copies occupy their key's block


def test_null_ids_are_kept(spark):
    for nulls in (0, 50, 67, 98, 100):
        rows = [(None if i < nulls else i, i) for i in range(100)]
        out = split_exact(spark.createDataFrame(rows, "id int, row int").repartition(4), "id", 0.8, 0.1, 42)
        got = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
        assert got == {"train": 80, "val": 10, "test": 10} and out.select("row").distinct().count() == 100


def test_seeded_rank_keeps_null_ids(spark):
    rows = [(None if i < 40 else i // 2, i) for i in range(100)]
    out = seeded_rank(spark.createDataFrame(rows, "id int, row int").repartition(4), "id", 42).collect()
    assert sorted(r["pos"] for r in out) == list(range(100)) and len({r["row"] for r in out}) == 100
