"""Prepare: raw rows -> cleaned, non-empty, label ids, exact seeded split (one table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.labels import label_dimension, with_label_id
from ..operators.split import split_exact
from ..session import materialize


def clean_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Clean the text column and drop rows whose cleaned text is empty.

    The cleaned text is produced by a one-element generator so that it is computed once: a plain
    projection + filter lets the optimiser inline the regex chain into the filter (evaluating it
    twice) and push that filter below a preceding repartition, into the scan tasks.
    """
    others = [c for c in df.columns if c != text_col]
    once = df.select(*others, F.explode(F.array(clean_text(text_col))).alias(text_col))
    return once.where(F.length(text_col) > 0).select(*df.columns)


def dropped_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows_before, rows_after, rows_dropped`` of the empty-text filter, in one aggregate."""
    empty = F.length(clean_text(text_col)) == 0
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~empty).alias("rows_after"),
        F.count_if(empty).alias("rows_dropped"),
    )


def prepare(df: DataFrame, id_col: str = "abstract_id", text_col: str = "text", label_col: str = "label",
            train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42,
            label_dim: DataFrame | None = None, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """Return ``(prepared, label_dim)``: rows with cleaned text, ``label_id`` and ``split``.

    With ``write`` the cleaned rows are written once to the shared checkpoint folder before the
    split, so cleaning runs once and the split's histogram jobs scan only the id column.
    """
    rows = clean_rows(df, text_col)
    if write:
        rows = materialize(rows, "cleaned")
    dim = label_dimension(rows, label_col) if label_dim is None else label_dim
    cols = df.columns
    rows = with_label_id(rows, label_col, dim).select(*cols, "label_id")
    return split_exact(rows, id_col, train_ratio, val_ratio, seed), dim
