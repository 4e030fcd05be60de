from pyspark.sql import functions as F

from corpusflow.operators.extract import (DEFAULT_TERMS, dictionary_hits, dictionary_join, extract_terms,
                                          pattern_hits, term_counts)


def run(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()[0]


def test_demo_sentence(spark):
    s = "This study discusses lung cancer and pancreatic cancer treatment."
    assert run(spark, s, extract_terms) == ["Lung Cancer", "Pancreatic Cancer"]
    assert run(spark, "This study focuses on lung cancer treatment.", extract_terms) == ["Lung Cancer"]


def test_substring_rule_and_pattern_noise(spark):
    assert run(spark, "leukemias", extract_terms) == ["Leukemia"]
    assert run(spark, "risk of cancer", extract_terms) == ["Of Cancer"]
    assert run(spark, "of cancer cancer", extract_terms) == ["Of Cancer"]


def test_unicode_borders(spark):
    assert run(spark, "élung cancer", extract_terms) == ["Lung Cancer"]  # from the dictionary
    assert run(spark, "élung cancer", lambda c: pattern_hits(c)) == []
    assert run(spark, "élung cancer", lambda c: pattern_hits(c)) == ["Lung Cancer"]
    assert run(spark, "x lun" + "ǵ cancer", extract_terms) == []
    assert run(spark, "lung cancer", extract_terms) == []


def test_stopwords_and_null(spark):
    assert run(spark, "risk of cancer and lung cancer", lambda c: pattern_hits(c, stopwords=["of"])) == ["Lung Cancer"]
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(extract_terms("t")).first()[0] in (None, [])


def test_dictionary_hits_order_and_case(spark):
    assert run(spark, "MELANOMA and Leukemia", lambda c: dictionary_hits(c)) == ["Leukemia", "Melanoma"]
    assert len(DEFAULT_TERMS) == 17


def test_dictionary_join_shards_equal_single(spark):
    docs = spark.createDataFrame([(1, "the lung cancer study"), (2, "melanoma, leukemias"), (3, "nothing")],
                                 "doc_id int, text string")
    terms = spark.createDataFrame([(t,) for t in DEFAULT_TERMS], "term string")
    one = sorted(dictionary_join(docs, terms).select("doc_id", "term").collect())
    many = sorted(dictionary_join(docs, terms, max_terms=3).select("doc_id", "term").collect())
    assert one == many == [(1, "lung cancer"), (2, "leukemia"), (2, "melanoma")]


def test_dictionary_join_matches_brute_force(spark):
    """Token-substring equi-join + multi-word containment equal Python's ``in`` on every pair."""
    import random

    rnd = random.Random(7)
    alphabet = "abcé \u00a0\n,-"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += ["ABCabc", "", "x\u3000ab-c ab"]
    vocab = sorted({"ab", "abc", "bca", "c,a", "a-b", "é", "ab c", "b\u00a0c", "cab", "aaaa", "b-",
                    "a b c", "c\n\na", "bc a-", "a  b", " ab", "ab ", "é a", " ", "\n ", "  "})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    terms = spark.createDataFrame([(v,) for v in vocab], "term string")
    want = sorted((i, v) for i, t in enumerate(texts) for v in vocab if v in t.lower())
    for kw in ({}, {"max_terms": 2}, {"max_bytes": 200}):
        got = sorted(tuple(r) for r in dictionary_join(docs, terms, **kw).select("doc_id", "term").collect())
        assert got == want, kw


def test_dictionary_join_words_mode(spark):
    docs = spark.createDataFrame([(1, "the lung  cancer study"), (2, "leukemias")], "doc_id int, text string")
    terms = spark.createDataFrame([("lung cancer",), ("leukemia",)], "term string")
    got = sorted(dictionary_join(docs, terms, mode="words").select("doc_id", "term").collect())
    assert got == [(1, "lung cancer")]  # whole words only


def test_term_counts(spark):
    df = spark.createDataFrame([("lung cancer",), ("lung cancer; melanoma",)], "t string")
    ex = df.select(extract_terms("t").alias("extracted"))
    got = {r["name"]: r["n_docs"] for r in term_counts(ex).collect()}
    assert got == {"Lung Cancer": 2, "Melanoma": 1}
