"""Corpus statistics for the whole corpus and each split, in one pass (GROUPING SETS)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def corpus_stats(df: DataFrame, text_col: str = "text", label_col: str = "label", split_col: str = "split",
                 global_name: str = "global", scopes: list[str] | None = None, chars_col: str | None = None,
                 words_col: str | None = None) -> DataFrame:
    """One row per scope: ``scope, num_samples, label_counts, avg_len_chars, avg_len_words,
    min_len_words, max_len_words``.

    ``text_col`` must hold cleaned text (single spaces, stripped), or ``chars_col`` and ``words_col`` its lengths. One scan feeds one aggregate
    over the grouping sets ``(split, label), (label), (split), ()``; a second aggregate over its at
    most scopes x (labels + 1) rows takes each scope's totals and folds its label rows into
    ``label_counts`` (most frequent first, then label; a missing label is a sample but no entry) – no join. ``scopes`` (if given) adds rows for empty scopes, with nulls.
    """
    base = df.select(
        F.col(split_col).alias("_split"),
        F.col(label_col).alias("_label"),
        (F.col(chars_col) if chars_col else F.length(text_col)).alias("_chars"),
        (F.col(words_col) if words_col else word_count(text_col)).alias("_words"),
    )
    g = base.groupingSets([["_split", "_label"], ["_label"], ["_split"], []], "_split", "_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_chars").alias("avg_len_chars"),
        F.avg("_words").alias("avg_len_words"),
        F.min("_words").cast("int").alias("min_len_words"),
        F.max("_words").cast("int").alias("max_len_words"),
        F.grouping("_split").alias("_gs"),
        F.grouping("_label").alias("_gl"),
    )
    scope = F.when(F.col("_gs") == 1, F.lit(global_name)).otherwise(F.col("_split"))
    g = g.withColumn("scope", scope)
    # one aggregate per scope: the scope's total row gives the scalars, its label rows the map
    tot = F.col("_gl") == 1

    def scalar(c: str):
        return F.first(F.when(tot, F.col(c)), ignorenulls=True).alias(c)

    entries = F.array_sort(
        F.collect_list(F.when(~tot & F.col("_label").isNotNull(), F.struct(F.col("n"), F.col("_label")))),
        lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1)
        .when(a["_label"] < b["_label"], -1).when(a["_label"] > b["_label"], 1).otherwise(0),
    )
    out = g.groupBy("scope").agg(
        F.first(F.when(tot, F.col("n")), ignorenulls=True).alias("num_samples"),
        *[scalar(c) for c in ("avg_len_chars", "avg_len_words", "min_len_words", "max_len_words")],
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["_label"], e["n"]))).alias("label_counts"),
    )
    if scopes:
        spark = df.sparkSession
        want = spark.createDataFrame([(s,) for s in [global_name] + list(scopes)], "scope string")
        out = want.join(out, "scope", "left")
    return out.select("scope", "num_samples", "label_counts", "avg_len_chars", "avg_len_words",
                      "min_len_words", "max_len_words")


def label_counts(df: DataFrame, label_col: str = "label", split_col: str = "split",
                 global_name: str = "global") -> DataFrame:
    """Long form ``scope, label, n``: rows per label for the whole corpus and each split."""
    g = df.groupingSets([[split_col, label_col], [label_col]], split_col, label_col).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(split_col).alias("_gs")
    )
    return g.select(
        F.when(F.col("_gs") == 1, F.lit(global_name)).otherwise(F.col(split_col)).alias("scope"),
        F.col(label_col).alias("label"),
        "n",
    )
