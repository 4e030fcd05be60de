"""Nearest-centroid classifier on frozen document vectors (a head with ``classes x dim`` parameters).

Fit: one mean vector per label (``Summarizer``, a partial aggregate of one buffer per label and task).
The centroid table is bounded by ``classes x dim`` (checked before it is collected), so scoring ships
it inside the projection as one literal and needs no join and no shuffle: squared distances by ``zip_with``/``aggregate``, prediction = nearest.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmin, softmax, squared_distance
from ..session import ensure_checkpoint_dir

MAX_PARAMS = 1_000_000  # classes x dim shipped as a literal


@dataclass
class CentroidModel:
    label_ids: list[int]
    centroids: list[list[float]]

    @property
    def num_params(self) -> int:
        return sum(len(c) for c in self.centroids)

    def distances(self, vec: Column | str) -> Column:
        v = F.col(vec) if isinstance(vec, str) else vec
        # one literal for the whole table, folded to an array when the query is planned
        table = F.from_json(F.lit(json.dumps(self.centroids)), "array<array<double>>")
        return F.transform(table, lambda c: squared_distance(v, c))

    def predict(self, df: DataFrame, vec_col: str = "embedding", pred_col: str = "pred_id",
                dist_col: str = "distances", prob_col: str | None = "probability") -> DataFrame:
        ids = F.array(*[F.lit(i) for i in self.label_ids])
        out = df.withColumn(dist_col, self.distances(vec_col))
        out = out.withColumn(pred_col, F.element_at(ids, argmin(dist_col) + 1))
        if prob_col:
            out = out.withColumn(prob_col, softmax(F.transform(dist_col, lambda d: -d)))
        return out


def fit_centroids(df: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                  max_params: int = MAX_PARAMS) -> CentroidModel:
    """Mean vector of each label; the table's size is checked before it comes to the driver."""
    v = df.select(F.col(label_col).cast("int").alias("l"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    means = v.where(F.col("v").isNotNull()).groupBy("l").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("c"))
    ensure_checkpoint_dir(df.sparkSession)
    means = means.checkpoint(eager=True)
    if (means.agg(F.sum(F.size("c"))).first()[0] or 0) > max_params:
        raise ValueError("centroid table too large to ship with the projection")
    rows = means.orderBy("l").collect()
    return CentroidModel([int(r["l"]) for r in rows], [[float(x) for x in r["c"]] for r in rows])
