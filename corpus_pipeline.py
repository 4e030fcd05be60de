"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The stages work on whole tables and whole texts, cover null and empty values as their
operators do, and keep what they do not decide against:

1. quality classifier: rows predicted low quality go;
2. n-gram Jaccard join (5-word shingles, similarity 0.8): of each class of near copies the smallest
   id stays;
3. suffix-array dedup: bytes of 100-byte strings that also start earlier go, the rest of the text stays;
4. benchmark decontamination: documents that align with a test item go;
5. mixing: the documents the mix takes, with how many of their words (repeats counted) it takes. Texts
   are those of stage 4; documents that are not taken go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, mixing, ngram_join, quality, suffix_dedup
from corpusflow.llm.common import materialize, read, with_columns

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = with_columns(docs, COLUMNS)
    labels = with_columns(read(spark, sf_dir, "labels"), {"doc_id": "long", "quality": "int"}).withColumnRenamed("quality", "label")
    model = quality.fit(d.select("doc_id", "text"), labels)
    return quality.score(d, model, tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(with_columns(docs, COLUMNS), SHINGLE_WORDS, SIMILAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(with_columns(docs, COLUMNS), keep=tuple(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.select(*[n_chars if c == "n_chars" else c for c in COLUMNS])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(with_columns(docs, COLUMNS), read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(with_columns(docs, COLUMNS), keep=("lang", "n_chars")).where("taken > 0")
    return mixed.select("doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: SQL expresses neither the classifier nor the byte-wise cuts; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
