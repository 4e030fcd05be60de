"""Spark ML linear classifiers and validation-split model selection.

* ``fit_text_lr`` – tokens -> hashed term frequencies -> IDF -> logistic regression
  (``RegexTokenizer, HashingTF, IDF, LogisticRegression`` in one ``Pipeline``).
* ``fit_vector_lr`` – a linear head on frozen document vectors (``array_to_vector`` ->
  ``LogisticRegression``); only the head's ``classes x (dim + 1)`` parameters are trained.
* ``select_on_validation`` – fit a grid of candidates on ``train``, score them on the fixed
  ``val`` split with the positive-class F1, keep the best (``row_number`` per model family).

Fits are full-batch L-BFGS: every iteration is one ``treeAggregate`` over the cached feature
partitions, so the corpus is read and featurised once, not once per iteration. A fit keeps the
partitions of its input, or spreads them to at least one per core; no task fits alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS
from ..functions.vectors import argmax
from ..operators.evaluate import evaluate
from ..operators.select import best_by
from ..session import spread

TOKEN_GAPS = WS + "+"  # a whitespace run


def text_pipeline(text_col: str = "text", label_col: str = "label_id", num_features: int = 1 << 18,
                  reg_param: float = 0.0, elastic_net: float = 0.0, max_iter: int = 100) -> Pipeline:
    tok = RegexTokenizer(inputCol=text_col, outputCol="_cf_words", pattern=TOKEN_GAPS, toLowercase=True)
    tf = HashingTF(inputCol="_cf_words", outputCol="_cf_tf", numFeatures=num_features)
    idf = IDF(inputCol="_cf_tf", outputCol="_cf_features")
    lr = LogisticRegression(featuresCol="_cf_features", labelCol=label_col, regParam=reg_param,
                            elasticNetParam=elastic_net, maxIter=max_iter, family="auto")
    return Pipeline(stages=[tok, tf, idf, lr])


def fit_text_lr(train: DataFrame, text_col: str = "text", label_col: str = "label_id", **kw) -> PipelineModel:
    data = spread(train.select(text_col, F.col(label_col).cast("double").alias(label_col)))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return text_pipeline(text_col, label_col, **kw).fit(data)
    finally:
        data.unpersist()


def fit_vector_lr(train: DataFrame, vec_col: str = "embedding", label_col: str = "label", reg_param: float = 0.0,
                  max_iter: int = 100) -> PipelineModel:
    """Linear head on frozen vectors (multinomial when there are more than two classes)."""
    data = spread(train.select(array_to_vector(F.col(vec_col)).alias("_cf_features"),
                                       F.col(label_col).cast("double").alias(label_col)))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lr = LogisticRegression(featuresCol="_cf_features", labelCol=label_col, regParam=reg_param, maxIter=max_iter)
        return PipelineModel(stages=[lr.fit(data)])
    finally:
        data.unpersist()


def predict_text(model: PipelineModel, df: DataFrame, prob_col: str = "probability", pred_col: str = "pred_id") -> DataFrame:
    """Score rows; ``probability`` as ``array<double>``, ``pred_id`` = first argmax."""
    out = model.transform(df)
    out = out.withColumn(prob_col, vector_to_array(F.col("probability")))
    drop = [c for c in ("_cf_words", "_cf_tf", "_cf_features", "rawPrediction", "prediction") if c in out.columns]
    return out.drop(*drop).withColumn(pred_col, argmax(prob_col))


def predict_vectors(model: PipelineModel, df: DataFrame, vec_col: str = "embedding", prob_col: str = "probability",
                    pred_col: str = "pred_id") -> DataFrame:
    out = model.transform(df.withColumn("_cf_features", array_to_vector(F.col(vec_col))))
    out = out.withColumn(prob_col, vector_to_array(F.col("probability")))
    return out.drop("_cf_features", "rawPrediction", "prediction").withColumn(pred_col, argmax(prob_col))


def trainable_parameters(model: PipelineModel) -> dict:
    """Trainable parameter count of the final linear stage vs. its input width."""
    lr = model.stages[-1]
    coef = lr.coefficientMatrix
    n = coef.numRows * coef.numCols + len(lr.interceptVector)
    return {"trainable": n, "input_width": coef.numCols, "classes": lr.numClasses}


@dataclass
class Selection:
    best: PipelineModel
    best_params: dict
    table: DataFrame  # candidate, params..., accuracy, precision, recall, f1, ...
    models: dict = field(default_factory=dict)


def select_on_validation(train: DataFrame, val: DataFrame, grid: list[dict], fit, predict,
                         label_col: str = "label_id", positive: int = 1, keep: int = 1) -> Selection:
    """Fit each parameter set on ``train``, evaluate on ``val`` and keep the best by F1.

    The candidates' predictions are united and evaluated in one grouped aggregate; the winner is
    ``row_number`` over F1 (ties: earlier candidate).
    """
    models, scored = {}, None
    for i, params in enumerate(grid):
        m = fit(train, **params)
        models[i] = m
        p = predict(m, val).select(F.lit(i).alias("candidate"), F.col(label_col).cast("int").alias("label_id"), "pred_id")
        scored = p if scored is None else scored.unionByName(p)
    metrics = evaluate(scored, group_cols=["candidate"], positive=positive)
    best = best_by(metrics, "f1", tie_cols=["candidate"], keep=keep).collect()  # at most ``keep`` rows
    i = int(best[0]["candidate"])
    return Selection(models[i], grid[i], metrics, models)


def select_text_lr(train: DataFrame, val: DataFrame, reg_params: list[float], text_col: str = "text",
                   label_col: str = "label_id", num_features: int = 1 << 18, max_iter: int = 100,
                   positive: int = 1, parallelism: int = 4) -> Selection:
    """Validation-split selection of the text classifier's regularisation.

    The featuriser (tokens -> hashed TF -> IDF) does not depend on the candidates, so it is fitted
    once and its output persisted; only the logistic-regression heads are fitted per candidate,
    concurrently from a thread pool (Spark runs the candidates' jobs side by side).
    """
    from concurrent.futures import ThreadPoolExecutor

    feat = Pipeline(stages=text_pipeline(text_col, label_col, num_features).getStages()[:3])
    data = spread(train.select(text_col, F.col(label_col).cast("double").alias(label_col)))
    fmodel = feat.fit(data)
    tr = fmodel.transform(data).select("_cf_features", label_col).persist(StorageLevel.MEMORY_AND_DISK)
    va = fmodel.transform(val.select(text_col, F.col(label_col).cast("double").alias(label_col))).select(
        "_cf_features", label_col)
    try:
        def fit_one(reg):
            lr = LogisticRegression(featuresCol="_cf_features", labelCol=label_col, regParam=reg, maxIter=max_iter)
            return lr.fit(tr)

        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(reg_params)))) as pool:
            heads = list(pool.map(fit_one, reg_params))
        scored = None
        for i, h in enumerate(heads):
            p = h.transform(va).select(F.lit(i).alias("candidate"), F.col(label_col).cast("int").alias("label_id"),
                                       argmax(vector_to_array("probability")).alias("pred_id"))
            scored = p if scored is None else scored.unionByName(p)
        metrics = evaluate(scored, group_cols=["candidate"], positive=positive)
        best = best_by(metrics, "f1", tie_cols=["candidate"]).collect()  # one row
        i = int(best[0]["candidate"])
        models = {j: PipelineModel(stages=fmodel.stages + [h]) for j, h in enumerate(heads)}
        return Selection(models[i], {"reg_param": reg_params[i], "num_features": num_features}, metrics, models)
    finally:
        tr.unpersist()
