"""End-to-end flows: the stages of the labelled-corpus workflow as functions over files.

* ``prepare_corpus``  class folders -> cleaned table (partitioned by split), label map, statistics
* ``train_naive_bayes`` / ``train_text_lr`` / ``train_vector_head``  prepared table -> model
* ``evaluate_model``  model + prepared table -> metrics per split (+ JSON records)
* ``compare_models``  metrics JSON files -> comparison rows (missing files reported, not fatal)
* ``predict_file``    scoring CSV -> prediction records (JSON lines)

Each writes its outputs with the sinks of ``sources.sinks`` and returns the DataFrames it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..models.linear import fit_text_lr, fit_vector_lr
from ..models.nb import NaiveBayesModel, fit_naive_bayes
from ..operators.compare import compare, metrics_json
from ..operators.evaluate import class_report, confusion_long, evaluate, report_text
from ..operators.labels import label_list
from ..operators.stats import corpus_stats
from ..sources import corpus as src
from ..sources import sinks
from .prepare import prepare
from .score import NaiveBayesScorer, score_table

SCOPES = ["train", "val", "test"]


def prepare_corpus(spark: SparkSession, root: str, out_dir: str, labels: list[str] | None = None,
                   train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42, csv: bool = False):
    """Folders -> ``out_dir/{prepared, label_map, stats}`` (+ ``prepared_csv`` by split and
    ``full_cleaned_csv``, the whole cleaned set as one export in path order)."""
    raw = src.read_class_folders(spark, root, required=labels)
    with src.packed_scan(spark):
        prepared, dim = prepare(raw, "abstract_id", "text", "label", train_ratio, val_ratio, seed)
    sinks.write_prepared(prepared, f"{out_dir}/prepared")
    if csv:
        sinks.write_prepared(prepared, f"{out_dir}/prepared_csv", fmt="csv")
        sinks.write_prepared(prepared, f"{out_dir}/full_cleaned_csv", fmt="csv", by_split=False, order_by="filepath")
    sinks.write_label_map(dim, f"{out_dir}/label_map")
    stats = corpus_stats(src.read_prepared(spark, f"{out_dir}/prepared"), scopes=SCOPES)
    sinks.write_stats(stats, f"{out_dir}/stats")
    return src.read_prepared(spark, f"{out_dir}/prepared"), dim, stats


def train_naive_bayes(prepared: DataFrame, dim: DataFrame, model_dir: str | None = None,
                      alpha: float = 1.0) -> NaiveBayesModel:
    tr = prepared.where(F.col("split") == "train").select(word_tokens("text").alias("tokens"), "label_id")
    model = fit_naive_bayes(tr, "tokens", "label_id", label_list(dim), alpha)
    if model_dir:
        model.save(model_dir)
    return model


def train_text_lr(prepared: DataFrame, model_dir: str | None = None, **kw):
    model = fit_text_lr(prepared.where(F.col("split") == "train"), "text", "label_id", **kw)
    if model_dir:
        sinks.save_model(model, model_dir)
    return model


def train_vector_head(vectors: DataFrame, vec_col: str, label_col: str, model_dir: str | None = None, **kw):
    model = fit_vector_lr(vectors, vec_col, label_col, **kw)
    if model_dir:
        sinks.save_model(model, model_dir)
    return model


def nb_predictions(model: NaiveBayesModel, prepared: DataFrame) -> DataFrame:
    z = model.logits(prepared.select("abstract_id", "split", "label_id", word_tokens("text").alias("tokens")),
                     "tokens", carry=["abstract_id", "split", "label_id"])
    return z.withColumn("pred_id", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))


def evaluate_model(preds: DataFrame, names: dict[int, str], model_name: str, out_dir: str | None = None,
                   splits: list[str] | None = None, layout: str = "evaluate", digits: int = 2) -> DataFrame:
    """Metrics per split (``split, accuracy, precision, recall, f1, confusion_matrix, ...``)."""
    p = preds.where(F.col("split").isin(splits)) if splits else preds
    classes = sorted(names)
    m = evaluate(p, group_cols=["split"], classes=classes)
    rep = report_text(class_report(confusion_long(p, group_cols=["split"], classes=classes), ["split"], names),
                      ["split"], digits)
    m = m.join(rep, "split", "left").withColumn("model", F.lit(model_name))
    if out_dir:
        sinks.write_metrics(metrics_json(m, layout, keep=["model", "split"]), f"{out_dir}/metrics", by="split")
    return m


def compare_models(spark: SparkSession, baseline_path: str, candidate_path: str) -> DataFrame:
    """Compare two metrics JSON files (any producer layout); a missing file gives null deltas."""
    core = src.read_metrics(spark, {"baseline": baseline_path, "candidate": candidate_path})
    return compare(core, "baseline", "candidate")


def predict_file(spark: SparkSession, csv_path: str, model: NaiveBayesModel, out_path: str | None = None,
                 clean: bool = False, extractor=None) -> DataFrame:
    """Scoring CSV -> prediction records; ids default to ``id_<row>``. Inference reads the raw text
    (as the reference does) unless ``clean``."""
    rows = src.read_scoring_csv(spark, csv_path)
    preds = score_table(rows, NaiveBayesScorer(model, clean=clean), extractor=extractor)
    if out_path:
        sinks.write_predictions(preds, out_path)
    return preds
