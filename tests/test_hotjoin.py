from corpusflow.operators.encode import build_vocab, encode
from corpusflow.operators.hotjoin import hot_cold_join, hot_keys


def _rows(spark):
    data = [("the", i) for i in range(600)] + [("of", i) for i in range(300)] + [(f"w{i}", i) for i in range(400)] + [(None, i) for i in range(50)] + [("absent", i) for i in range(200)]
    return spark.createDataFrame(data, "token string, i int").repartition(6)


def test_hot_keys_are_exact_for_any_sketch_size(spark):
    rows = _rows(spark)
    for cells in (1, 3, 1 << 16):
        got = {r.token for r in hot_keys(rows, "token", share=0.1, cells=cells).collect()}
        assert got == {"the", "of", "absent"}  # null is no key
    assert hot_keys(rows.where("false"), "token").count() == 0


def test_hot_cold_join_is_a_left_join(spark):
    rows = _rows(spark)
    dim = spark.createDataFrame([("the", 1), ("of", 2), *((f"w{i}", 10 + i) for i in range(0, 400, 2)), ("unused", 9)], "token string, token_id int")
    for share in (2.0, 0.1, 0.0):
        got = sorted(map(str, hot_cold_join(rows, dim, "token", share=share).select("token", "i", "token_id").collect()))
        assert got == sorted(map(str, rows.join(dim, "token", "left").select("token", "i", "token_id").collect()))


def test_hot_rows_are_not_shuffled(spark):
    rows, dim = _rows(spark), spark.createDataFrame([("the", 1), ("of", 2)], "token string, token_id int")
    plan = hot_cold_join(rows, dim, "token", share=0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("broadcast") >= 2


def test_encode_whole_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"] * 5), (3, []), (4, None), (1, ["a", "b", "a"]), (5, ["new", "a"])], "doc_id int, tokens array<string>")
    vocab = build_vocab(docs.where("doc_id < 5"), "tokens")
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert ids == {"c": 2, "a": 3, "b": 4}
    got = sorted((r.doc_id, r.input_ids, r.attention_mask) for r in encode(docs, "tokens", vocab, 4).collect())
    assert got == [(1, [3, 4, 3, 0], [1, 1, 1, 0]), (1, [3, 4, 3, 0], [1, 1, 1, 0]), (2, [2, 2, 2, 2], [1] * 4), (3, [0] * 4, [0] * 4), (4, [0] * 4, [0] * 4), (5, [1, 3, 0, 0], [1, 1, 0, 0])]
