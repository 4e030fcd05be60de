"""Scoring: a table (or one text) -> enriched predictions.

A prediction row is ``abstract_id, predicted_labels array<string>, confidence_scores
map<string,double>, extracted_diseases array<string>``. Extraction is a Column expression on the
raw text; the class probabilities come from a *scorer*:

* ``NaiveBayesScorer`` – the relational model of ``models.nb`` (JVM only);
* ``SparkMLScorer`` – any fitted Spark ML ``PipelineModel`` with a ``probability`` column;
* ``PandasScorer`` – an outside model called on pandas batches through ``mapInPandas`` (loaded once
  per task), for models Spark cannot express;
* ``ArrowScorer`` – the same over Arrow batches bounded by bytes, loaded once per Python worker.

A scorer maps ``(df, text_col, carry)`` to ``carry..., probs array<double>``; only the id and the
extracted names are carried, so the text does not cross a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import word_tokens
from ..functions.vectors import argmax, confidence_map, label_of, softmax
from ..operators.extract import extract_terms
from ..schemas import SCORING_INPUT


class NaiveBayesScorer:
    def __init__(self, model, clean: bool = False):
        self.model, self.labels, self.clean = model, model.labels, clean

    def scores(self, df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
        tok = df.select(*carry, word_tokens(text_col, clean=self.clean).alias("_cf_tokens"))
        return self.model.logits(tok, "_cf_tokens", carry=carry).select(*carry, softmax("logits").alias("probs"))


class SparkMLScorer:
    def __init__(self, model, labels: list[str], input_col: str = "text"):
        self.model, self.labels, self.input_col = model, labels, input_col

    def scores(self, df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(df.select(*carry, F.col(text_col).alias(self.input_col)))
        return out.select(*carry, vector_to_array("probability").alias("probs"))


class PandasScorer:
    """Wrap ``predict(texts: pandas.Series) -> 2-D array of logits`` for ``mapInPandas``.

    ``load`` (optional) builds the model once per task; ``predict`` gets ``(model, texts)``
    when ``load`` is given. Logits are turned into probabilities by ``softmax`` in the JVM.
    """

    def __init__(self, predict: Callable, labels: list[str], load: Callable | None = None):
        self.predict, self.labels, self.load = predict, labels, load

    def scores(self, df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
        predict, load = self.predict, self.load
        fields = [df.schema[c] for c in carry]
        schema = T.StructType(fields + [T.StructField("logits", T.ArrayType(T.DoubleType()))])

        def run(batches):
            model = load() if load else None
            for pdf in batches:
                texts = pdf[text_col].fillna("")
                z = predict(model, texts) if load else predict(texts)
                out = pdf[carry].copy()
                out["logits"] = np.asarray(z, dtype="float64").tolist()
                yield out

        scored = df.select(*carry, text_col).mapInPandas(run, schema)
        return scored.select(*carry, softmax("logits").alias("probs"))


# models loaded in this Python worker, by scorer
_loaded: dict[str, object] = {}


def _model_of(key: str, load: Callable) -> object:
    """The scorer's model in this worker. (A function of the module, so that tasks share the module's dict.)"""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


class ArrowScorer:
    """An outside model over Arrow batches whose text is bounded by bytes, loaded once per Python worker.

    ``predict(model, texts: pyarrow.Array) -> 2-D array of logits``; ``load() -> model`` runs when a worker first
    needs it and serves all its later tasks. A batch of long texts is cut into slices of at most ``batch_bytes`` (a
    longer text is a slice of its own), so a task's memory does not depend on how many rows a batch has. Null
    texts are empty.
    """

    def __init__(self, predict: Callable, labels: list[str], load: Callable, batch_bytes: int = 8 << 20):
        self.predict, self.labels, self.load, self.batch_bytes = predict, labels, load, batch_bytes
        self.key = uuid.uuid4().hex

    def scores(self, df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
        predict, load, key, limit = self.predict, self.load, self.key, self.batch_bytes
        schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("logits", T.ArrayType(T.DoubleType()))])

        def run(batches):
            model = _model_of(key, load)
            for batch in batches:
                texts = pc.fill_null(batch.column(text_col), "")
                end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                lo = 0
                while lo < batch.num_rows:
                    start = end[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(end, start + limit, "right")))
                    z = np.asarray(predict(model, texts.slice(lo, hi - lo)), np.float64)
                    logits = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                    part = batch.select(carry).slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*part.columns, logits], [*carry, "logits"])
                    lo = hi

        scored = df.select(*carry, text_col).mapInArrow(run, schema)
        return scored.select(*carry, softmax("logits").alias("probs"))


def predictions(scored: DataFrame, labels: list[str], id_col: str = "abstract_id",
                extracted_col: str = "extracted_diseases") -> DataFrame:
    """Shape ``carry..., probs`` into prediction records."""
    pred = argmax("probs")
    return scored.select(
        F.col(id_col).cast("string").alias("abstract_id"),
        F.array(label_of(labels, pred)).alias("predicted_labels"),
        confidence_map(labels, "probs").alias("confidence_scores"),
        F.col(extracted_col).alias("extracted_diseases"),
    )


def score_table(df: DataFrame, scorer, text_col: str = "text", id_col: str = "abstract_id",
                extractor: Callable[[Column], Column] | None = None, score_col: str | None = None) -> DataFrame:
    """Enriched predictions for every row of ``df`` (ids kept as strings).

    Names are extracted from ``text_col``; the scorer reads ``score_col`` when given (e.g. a cleaned
    copy of the text in the same row), else ``text_col``.
    """
    extractor = extractor or (lambda c: extract_terms(c))
    base = df.select(F.col(id_col).cast("string").alias("abstract_id"), F.col(text_col).alias("_cf_text"),
                     F.col(score_col or text_col).alias("_cf_score"))
    base = base.withColumn("extracted_diseases", extractor(F.col("_cf_text"))).drop("_cf_text")
    scored = scorer.scores(base, "_cf_score", ["abstract_id", "extracted_diseases"])
    return predictions(scored, scorer.labels)


def score_text(spark: SparkSession, text: str, scorer, extractor: Callable[[Column], Column] | None = None,
               abstract_id: str = "manual_input") -> DataFrame:
    """One literal text as a one-row source, id ``manual_input``."""
    df = spark.createDataFrame([(abstract_id, text)], SCORING_INPUT)
    return score_table(df, scorer, extractor=extractor)
