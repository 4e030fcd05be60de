"""Metrics records: JSON layouts, alias-tolerant reading, and baseline-vs-candidate comparison.

A metrics record is JSON text (one file or one column value per model). ``extract_core`` reads the
six core metrics whatever the producer called them: for each metric the first *present* key of its
alias list wins (a present ``null`` is kept, not skipped), and a record without accuracy that has a
``metrics`` object is read from that object instead. Everything is ``get_json_object`` /
``json_object_keys`` – row-local, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let

# --- fixed values: accepted key names per metric, in order of preference ----------------------
CORE_ALIASES = {
    "accuracy": ["accuracy", "eval_accuracy"],
    "f1": ["f1", "f1_score", "eval_f1"],
    "precision": ["precision", "eval_precision"],
    "recall": ["recall", "eval_recall"],
    "confusion_matrix": ["confusion_matrix", "eval_confusion_matrix"],
    "classification_report": ["classification_report", "report"],
}
WRAPPER_KEY = "metrics"
REQUIRED = ["accuracy", "f1", "confusion_matrix"]
# ---------------------------------------------------------------------------------------------

CM_TYPE = "array<array<bigint>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(j: Column | str, names: list[str]) -> Column:
    """JSON text of the first key of ``names`` present in object ``j`` (null when none is present,
    and null when the present key holds null)."""
    jc = _col(j)
    keys = F.json_object_keys(jc)
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.coalesce(F.array_contains(keys, n), F.lit(False)), F.get_json_object(jc, f"$.{n}")).otherwise(out)
    return out


def _core(j: Column) -> Column:
    a = CORE_ALIASES
    return F.struct(
        pick(j, a["accuracy"]).cast("double").alias("accuracy"),
        pick(j, a["f1"]).cast("double").alias("f1"),
        pick(j, a["precision"]).cast("double").alias("precision"),
        pick(j, a["recall"]).cast("double").alias("recall"),
        F.from_json(pick(j, a["confusion_matrix"]), CM_TYPE).alias("confusion_matrix"),
        pick(j, a["classification_report"]).alias("classification_report"),
    )


def _unwrapped(j: Column) -> Column:
    """The record itself: while accuracy is missing and there is a ``metrics`` object, that object.

    A record cannot be wrapped more often than the key's name occurs in it, so that bounds the steps.
    """

    def step(x: Column, _: Column) -> Column:
        has_wrapper = F.coalesce(F.array_contains(F.json_object_keys(x), WRAPPER_KEY), F.lit(False))
        bare = pick(x, CORE_ALIASES["accuracy"]).cast("double").isNull()
        return F.when(bare & has_wrapper, F.get_json_object(x, f"$.{WRAPPER_KEY}")).otherwise(x)

    levels = F.sequence(F.lit(1), F.regexp_count(j, F.lit(f'"{WRAPPER_KEY}"')) + 1)
    return F.when(j.isNotNull(), F.aggregate(levels, j, step))


def extract_core(j: Column | str) -> Column:
    """Struct ``accuracy, f1, precision, recall, confusion_matrix, classification_report``.

    Descends into ``metrics`` as long as accuracy is missing, however deep.
    """
    return let(_unwrapped(_col(j)), _core)


def flat_cm_stats(cm: Column | str) -> Column:
    """``struct(tn, fp, fn, tp)`` of a 2 x 2 matrix (rows true, columns predicted), else null."""
    m = _col(cm)
    ok = m.isNotNull() & (F.size(m) == 2) & (F.size(m[0]) == 2)
    s = F.struct(m[0][0].alias("tn"), m[0][1].alias("fp"), m[1][0].alias("fn"), m[1][1].alias("tp"))
    return F.when(ok, s)


def metrics_json(m: DataFrame, layout: str = "evaluate", keep: list[str] | None = None) -> DataFrame:
    """Serialise metric rows (from ``evaluate``) as JSON text in one of the producers' layouts.

    ``evaluate``: accuracy, precision, recall, f1_score, confusion_matrix, classification_report.
    ``finetune``: accuracy, f1, precision, recall, confusion_matrix, classification_report.
    ``trainer``:  {"metrics": {eval_accuracy, eval_f1, eval_precision, eval_recall,
    eval_confusion_matrix}, "epoch": ...}. ``trainer_flat``: the same keys without the wrapper, as a trainer
    writes them after its last epoch.
    """
    keep = list(keep or [])
    report = F.col("classification_report") if "classification_report" in m.columns else F.lit(None).cast("string")
    base = [F.col("accuracy"), F.col("precision"), F.col("recall")]
    if layout == "evaluate":
        body = F.struct(*base, F.col("f1").alias("f1_score"), F.col("confusion_matrix"), report.alias("classification_report"))
    elif layout == "finetune":
        body = F.struct(F.col("accuracy"), F.col("f1"), F.col("precision"), F.col("recall"), F.col("confusion_matrix"),
                        report.alias("classification_report"))
    elif layout == "trainer":
        inner = F.struct(*[F.col(c).alias(f"eval_{c}") for c in ("accuracy", "f1", "precision", "recall", "confusion_matrix")])
        body = F.struct(inner.alias(WRAPPER_KEY), F.lit(3.0).alias("epoch"))
    elif layout == "trainer_flat":
        body = F.struct(*[F.col(c).alias(f"eval_{c}") for c in ("accuracy", "f1", "precision", "recall", "confusion_matrix")])
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return m.select(*keep, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def core_table(df: DataFrame, json_col: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Flatten ``extract_core`` of each record into columns (plus ``tn, fp, fn, tp``)."""
    keep = list(keep or [])
    c = df.select(*keep, extract_core(json_col).alias("_c"))
    c = c.select(*keep, "_c.*")
    return c.select("*", flat_cm_stats("confusion_matrix").alias("_s")).select(
        "*", *[F.col(f"_s.{x}").alias(x) for x in ("tn", "fp", "fn", "tp")]).drop("_s")


def compare(core: DataFrame, baseline: str, candidate: str, model_col: str = "model",
            on: list[str] | None = None) -> DataFrame:
    """Candidate minus baseline, per key ``on`` (an equi-join of the two models' rows).

    ``delta_accuracy``; ``delta_f1`` only when both F1s exist; ``delta_fp``/``delta_fn`` only when both
    matrices are 2 x 2; ``missing`` lists required metrics absent on either side; ``*_text`` are
    the display strings (``%.4f`` values, ``%+.4f`` differences).
    """
    on = list(on or [])
    cols = ["accuracy", "f1", "confusion_matrix", "fp", "fn", "classification_report"]
    m = F.col(model_col)
    # one conditional aggregate per key instead of a join of the two models' rows (each model has
    # at most one row per key; a present null stays null)
    aggs = [F.first(F.when(m == F.lit(name), F.col(c)), ignorenulls=True).alias(f"{tag}_{c}")
            for tag, name in (("base", baseline), ("cand", candidate)) for c in cols]
    seen = [F.count_if(m == F.lit(baseline)).alias("_cf_nb"), F.count_if(m == F.lit(candidate)).alias("_cf_nc")]
    rows = core.where(m.isin(baseline, candidate))
    j = (rows.groupBy(*on).agg(*aggs, *seen) if on else rows.agg(*aggs, *seen)).where(
        (F.col("_cf_nb") > 0) & (F.col("_cf_nc") > 0))
    twice = (F.col("_cf_nb") > 1) | (F.col("_cf_nc") > 1)
    j = j.where(F.when(twice, F.raise_error(F.lit("a model has several metric records; name a key in `on`")).cast("boolean")).otherwise(True))
    key = on

    def both(x: str) -> Column:
        return F.col(f"base_{x}").isNotNull() & F.col(f"cand_{x}").isNotNull()

    def delta(x: str) -> Column:
        return F.when(both(x), F.col(f"cand_{x}") - F.col(f"base_{x}"))

    missing = F.array_compact(F.array(*[F.when(~both(x), F.lit(x)) for x in REQUIRED]))
    out = j.select(
        *key, F.lit(baseline).alias("baseline"), F.lit(candidate).alias("candidate"),
        "base_accuracy", "cand_accuracy", delta("accuracy").alias("delta_accuracy"),
        "base_f1", "cand_f1", delta("f1").alias("delta_f1"),
        delta("fp").alias("delta_fp"), delta("fn").alias("delta_fn"),
        "base_confusion_matrix", "cand_confusion_matrix", "base_classification_report", "cand_classification_report",
        missing.alias("missing"),
        F.format_string("%.4f", "base_accuracy").alias("base_accuracy_text"),
        F.format_string("%.4f", "cand_accuracy").alias("cand_accuracy_text"),
        F.when(both("accuracy"), F.format_string("%+.4f", delta("accuracy"))).alias("delta_accuracy_text"),
        F.when(both("f1"), F.format_string("%+.4f", delta("f1"))).alias("delta_f1_text"),
    )
    return out
