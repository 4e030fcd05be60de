"""Small helpers shared by the operators: word rules, row keys, folds, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.vectors import let
from corpusflow.session import scratch_path

__all__ = ["WORD", "SPACE_CLASS", "let", "materialize", "read", "text_key", "fold", "with_columns", "word_count", "blank_if_null", "bounded_sample"]

#: Space, tab, line feed, vertical tab, form feed, carriage return: what parts words (fixed by the contract).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A word by that rule.
WORD = r"[^\x20\x09-\x0D]+"


#: Drops a finished write's shuffle files at once instead of when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Batches of whole texts for Python tasks are bounded by bytes, not only by rows.
_BATCH_BYTES, _MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch's bytes (64 MB by default) to a few megabytes."""
    if int(spark.conf.get(_BATCH_BYTES).rstrip("bB")) != _MOST_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(_MOST_BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write into the shared checkpoint folder and read back: cuts the lineage, frees the shuffles behind it."""
    spark = df.sparkSession
    bounded_batches(spark)
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder, through Spark's reader only."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), as a long."""
    return F.regexp_count(blank_if_null(text), F.lit(WORD)).cast("long")


def text_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a row's id and text.

    Rows that agree in both get the same key and the same result, so joining results back by
    ``(doc_id, key)`` never multiplies repeated rows and needs no generated row number.
    """
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")), text.isNull())


def bounded_sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` of the rows, each (doc_id, text) once, by least hash of both: the same rows in every run.

    For samples that go to the driver: an id or a text with a large share of all rows cannot widen them.
    """
    return rows.dropDuplicates(["doc_id", "text"]).orderBy(F.xxhash64("doc_id", "text", F.lit(seed))).limit(most)


def fold(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id written as text, modulo ``modulus`` (null id: fold of the empty text)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def with_columns(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Exactly the named columns, cast; a missing one is null. Extra columns of any name are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in needed.items()])
