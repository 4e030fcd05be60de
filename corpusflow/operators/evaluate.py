"""Classifier evaluation: confusion matrix, accuracy/precision/recall/F1, per-class report.

All metrics derive from one aggregate – counts per ``(group..., true, predicted)`` – which is at most
groups x classes^2 rows whatever the number of scored rows; everything after it runs on that small
table. The class list is the sorted union of true and predicted ids (size-checked before it is
used as a literal). Zero denominators give 0, as the usual metric libraries do by default.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import let
from ..session import materialize

MAX_CLASSES = 10_000
# classes up to which the dense matrix is given without being asked for (its cells are one row)
MAX_DENSE = 512


def class_ids(df: DataFrame, label_col: str, pred_col: str, max_classes: int = MAX_CLASSES) -> list[int]:
    """Sorted union of the true and predicted ids (bounded)."""
    u = df.select(F.col(label_col).alias("c")).unionByName(df.select(F.col(pred_col).alias("c"))).distinct()
    rows = u.where(F.col("c").isNotNull()).orderBy("c").limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    return [int(r[0]) for r in rows]


def _bounded_classes(counts: DataFrame, limit: int) -> list[int] | None:
    """The classes of a count table, or None if there are more than ``limit``."""
    try:
        return class_ids(counts, "true_id", "pred_id", limit)
    except ValueError:
        return None


def confusion_sparse(df: DataFrame, label_col: str = "label_id", pred_col: str = "pred_id",
                     group_cols: list[str] | None = None) -> DataFrame:
    """``group..., true_id, pred_id, n``: the pairs that occur. One partial aggregate; as many rows as there are
    different pairs, whatever the number of classes, and the input that ``class_report`` takes."""
    return _counts(df, label_col, pred_col, list(group_cols or [])).where(F.col("true_id").isNotNull() & F.col("pred_id").isNotNull())


def custom_metrics(df: DataFrame, metric: Callable[[np.ndarray, np.ndarray, np.ndarray], float], name: str, label_col: str = "label_id",
                   pred_col: str = "pred_id", group_cols: list[str] | None = None) -> DataFrame:
    """``group..., <name>``: a user's metric ``f(true ids, predicted ids, counts) -> float`` for each group.

    The function sees a group's distinct pairs with their numbers, as Arrow columns, so a task holds at most the pairs that
    occur (classes squared), never the group's rows. For what aggregate Columns (``evaluate(extra=...)``) cannot say.
    """
    group_cols = list(group_cols or [])
    counts = confusion_sparse(df, label_col, pred_col, group_cols)
    keys = [counts.schema[c] for c in group_cols]
    schema = T.StructType([*keys, T.StructField(name, T.DoubleType())])

    def of_group(pairs: pa.Table) -> pa.Table:
        t, p, n = (pairs.column(c).to_numpy() for c in ("true_id", "pred_id", "n"))
        head = [pairs.column(k.name).slice(0, 1).combine_chunks() for k in keys]
        value = pa.array([float(metric(t, p, n))], pa.float64())
        return pa.Table.from_arrays([*head, value], names=[*group_cols, name])

    return counts.groupBy(*group_cols).applyInArrow(of_group, schema)


def _counts(df: DataFrame, label_col: str, pred_col: str, group_cols: list[str]) -> DataFrame:
    return df.groupBy(*group_cols, F.col(label_col).cast("int").alias("true_id"),
                      F.col(pred_col).cast("int").alias("pred_id")).agg(F.count(F.lit(1)).alias("n"))


def confusion_long(df: DataFrame, label_col: str = "label_id", pred_col: str = "pred_id",
                   group_cols: list[str] | None = None, classes: list[int] | None = None) -> DataFrame:
    """``group..., true_id, pred_id, n`` over the full class x class grid (zeros included)."""
    group_cols = list(group_cols or [])
    return _grid(*_counted(df, label_col, pred_col, group_cols, classes), group_cols)


def _counted(df: DataFrame, label_col: str, pred_col: str, group_cols: list[str], classes: list[int] | None):
    """The count table and the class list; without given classes, or with groups (whose grid reads the counts
    twice), the counts are written once, so the predictions are scanned once and the classes come from the counts."""
    c = _counts(df, label_col, pred_col, group_cols)
    if classes is None or group_cols:
        c = materialize(c, "confusion_counts")
    if classes is None:
        classes = class_ids(c, "true_id", "pred_id")
    return c, classes


def _grid(c: DataFrame, classes: list[int], group_cols: list[str]) -> DataFrame:
    """Counts over the full class x class grid: zero cells and counts side by side, summed."""
    ids = F.array(*[F.lit(int(i)) for i in classes]).cast("array<int>")
    groups = c.select(*group_cols).distinct() if group_cols else c.sparkSession.range(1).select()
    grid = groups.select(*group_cols, F.explode(ids).alias("true_id")).select(*group_cols, "true_id", F.explode(ids).alias("pred_id"))
    known = c.where(F.col("true_id").isin(classes) & F.col("pred_id").isin(classes))
    cells = grid.select("*", F.lit(0).cast("long").alias("n")).unionByName(known.select(*group_cols, "true_id", "pred_id", "n"))
    return cells.groupBy(*group_cols, "true_id", "pred_id").agg(F.sum("n").alias("n"))


def confusion_wide(long: DataFrame, classes: list[int], group_cols: list[str] | None = None,
                   prefix: str = "pred_") -> DataFrame:
    """One row per true id, one column per predicted id."""
    group_cols = list(group_cols or [])
    return long.groupBy(*group_cols, "true_id").pivot("pred_id", classes).agg(F.sum("n")).select(
        *group_cols, "true_id", *[F.col(str(c)).cast("long").alias(f"{prefix}{c}") for c in classes])


def confusion_nested(long: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """``group..., confusion_matrix array<array<bigint>>`` – rows = true, columns = predicted."""
    group_cols = list(group_cols or [])
    rows = long.groupBy(*group_cols, "true_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pred_id", "n"))), lambda s: s["n"]).alias("_row"))
    agg = F.transform(F.array_sort(F.collect_list(F.struct("true_id", "_row"))), lambda s: s["_row"]).alias(
        "confusion_matrix")
    return rows.groupBy(*group_cols).agg(agg) if group_cols else rows.agg(agg)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def evaluate(df: DataFrame, label_col: str = "label_id", pred_col: str = "pred_id", positive: int = 1,
             group_cols: list[str] | None = None, classes: list[int] | None = None,
             extra: dict[str, Column] | None = None, dense: bool | None = None) -> DataFrame:
    """Metric bundle per group: ``accuracy, precision, recall, f1`` (for class ``positive``),
    ``confusion_matrix``, ``tn, fp, fn, tp`` (2 x 2 only, else null), ``support``, and any
    ``extra`` aggregate Columns (custom metrics over the prediction rows).

    The metrics come from the counted (true, predicted) pairs, however many classes there are. The dense
    ``confusion_matrix`` is one row of classes squared cells: it is given up to ``MAX_DENSE`` classes, beyond them
    (up to ``MAX_CLASSES``) only with ``dense=True``, and null otherwise; ``confusion_sparse`` and
    ``class_report`` serve any number of classes."""
    group_cols = list(group_cols or [])
    counts = _counts(df, label_col, pred_col, group_cols)
    if classes is None or group_cols:  # the grid reads the counts for its groups and for its cells
        counts = materialize(counts, "confusion_counts")
    if dense is None or dense:
        limit = MAX_DENSE if dense is None else MAX_CLASSES
        classes = _bounded_classes(counts, limit) if classes is None else classes
        if classes is not None and len(classes) > limit:
            classes = None
        if dense and classes is None:
            raise ValueError(f"more than {MAX_CLASSES} classes for a dense matrix")
    else:
        classes = None
    t, p, n = F.col("true_id"), F.col("pred_id"), F.col("n")
    rows = counts.where(t.isNotNull() & p.isNotNull())
    if classes is not None:
        # the complete class x class grid: its cells sorted by (true, pred) are the matrix in row-major order, so
        # the nested matrix comes out of the same aggregate as the metrics, no join
        rows = _grid(rows, classes, group_cols)
    pos = F.lit(positive)

    def s(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(F.lit(0)))

    tp, fp, fn = s((t == pos) & (p == pos)), s((t != pos) & (p == pos)), s((t == pos) & (p != pos))
    aggs = [
        F.sum("n").alias("support"),
        _ratio(s(t == p), F.sum("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]
    two = classes is not None and len(classes) == 2
    for name, (ti, pi) in {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}.items():
        val = s((t == F.lit(classes[ti])) & (p == F.lit(classes[pi]))) if two else F.lit(None).cast("long")
        aggs.append(val.cast("long").alias(name))
    if classes:
        k = len(classes)
        cells = F.array_sort(F.collect_list(F.struct(t, p, n)))
        matrix = let(cells, lambda c: F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(F.slice(c, i * k + 1, F.lit(k)), lambda x: x["n"])))
    else:
        matrix = F.lit(None).cast("array<array<bigint>>") if classes is None else F.array().cast("array<array<bigint>>")
    aggs.append(matrix.alias("confusion_matrix"))
    out = rows.groupBy(*group_cols).agg(*aggs) if group_cols else rows.agg(*aggs)
    if extra:
        more = df.groupBy(*group_cols).agg(*[v.alias(k) for k, v in extra.items()]) if group_cols else \
            df.agg(*[v.alias(k) for k, v in extra.items()])
        out = merge_rows(out, more, group_cols)
    return out


def merge_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``a`` and ``b`` side by side per key, for inputs with at most one row per key.

    A union with null padding, then ``first`` per key – no join, so an empty key list (one global
    row each) needs no constant-key cross product.
    """
    a_cols = [c for c in a.columns if c not in keys]
    b_cols = [c for c in b.columns if c not in keys]

    def padded(df: DataFrame, own: list[str]) -> DataFrame:
        fields = {f.name: f.dataType for f in a.schema.fields + b.schema.fields}
        return df.select(*keys, *[F.col(c) if c in own else F.lit(None).cast(fields[c]).alias(c) for c in a_cols + b_cols])

    u = padded(a, a_cols).unionByName(padded(b, b_cols))
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in a_cols + b_cols]
    return u.groupBy(*keys).agg(*aggs) if keys else u.agg(*aggs)


def class_report(long: DataFrame, group_cols: list[str] | None = None, names: dict[int, str] | None = None) -> DataFrame:
    """Per-class ``precision, recall, f1, support`` plus ``accuracy``, ``macro avg`` and
    ``weighted avg`` rows, from the long confusion table. ``class_id`` orders the classes (null for
    the summary rows)."""
    group_cols = list(group_cols or [])
    t, p, n = F.col("true_id"), F.col("pred_id"), F.col("n")
    # every cell counts once for its true class (support, hits) and once for its predicted class
    side = "struct<class_id:int,support:bigint,tp:bigint,pred:bigint>"
    zero = F.lit(0).cast("long")
    cell = F.explode(F.array(
        F.struct(t.alias("class_id"), n.cast("long").alias("support"), F.when(t == p, n).otherwise(zero).cast("long").alias("tp"),
                 zero.alias("pred")).cast(side),
        F.struct(p.alias("class_id"), zero.alias("support"), zero.alias("tp"), n.cast("long").alias("pred")).cast(side),
    )).alias("_e")
    per = long.select(*group_cols, cell).groupBy(*group_cols, F.col("_e.class_id").alias("class_id")).agg(
        F.sum("_e.support").alias("support"), F.sum("_e.tp").alias("_tp"), F.sum("_e.pred").alias("_pred"))
    per = per.select(
        *group_cols, "class_id",
        _ratio(F.col("_tp"), F.col("_pred")).alias("precision"),
        _ratio(F.col("_tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_pred") + F.col("support")).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("_tp"),
    )
    if names:
        nm = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
        cls = F.element_at(nm, F.col("class_id"))
    else:
        cls = F.col("class_id").cast("string")
    per = per.withColumn("class", cls)
    g = per.groupBy(*group_cols) if group_cols else per
    tot = F.sum("support")
    summary = g.agg(
        _ratio(F.sum("_tp"), tot).alias("_acc"), tot.alias("_tot"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        _ratio(F.sum(F.col("precision") * F.col("support")), tot).alias("_wp"),
        _ratio(F.sum(F.col("recall") * F.col("support")), tot).alias("_wr"),
        _ratio(F.sum(F.col("f1") * F.col("support")), tot).alias("_wf"),
    )
    null = F.lit(None).cast("double")
    acc = summary.select(*group_cols, F.lit("accuracy").alias("class"), null.alias("precision"), null.alias("recall"),
                         F.col("_acc").alias("f1"), F.col("_tot").cast("long").alias("support"))
    macro = summary.select(*group_cols, F.lit("macro avg").alias("class"), F.col("_mp").alias("precision"),
                           F.col("_mr").alias("recall"), F.col("_mf").alias("f1"), F.col("_tot").cast("long").alias("support"))
    weighted = summary.select(*group_cols, F.lit("weighted avg").alias("class"), F.col("_wp").alias("precision"),
                              F.col("_wr").alias("recall"), F.col("_wf").alias("f1"), F.col("_tot").cast("long").alias("support"))
    body = per.select(*group_cols, "class", "precision", "recall", "f1", "support", "class_id")
    return body.unionByName(acc.unionByName(macro).unionByName(weighted), allowMissingColumns=True)


def report_text(report: DataFrame, group_cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """The report as one fixed-width text block per group (``classification_report`` string)."""
    group_cols = list(group_cols or [])
    fmt = f"%.{digits}f"

    def num(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string(fmt, F.col(c)))

    line = F.format_string("%14s %9s %9s %9s %9d", F.col("class"), num("precision"), num("recall"), num("f1"), F.col("support"))
    order = F.when(F.col("class") == "accuracy", 1).when(F.col("class") == "macro avg", 2).when(
        F.col("class") == "weighted avg", 3).otherwise(0)
    lines = report.select(*group_cols, F.struct(order.alias("o"), F.col("class_id").alias("i"), F.col("class").alias("c"), line.alias("l")).alias("_x"))
    header = F.format_string("%14s %9s %9s %9s %9s", F.lit(""), F.lit("precision"), F.lit("recall"), F.lit("f1-score"), F.lit("support"))
    text = F.concat_ws("\n", F.array_prepend(F.transform(F.array_sort(F.collect_list("_x")), lambda s: s["l"]), header))
    g = lines.groupBy(*group_cols) if group_cols else lines
    return g.agg(text.alias("classification_report"))
