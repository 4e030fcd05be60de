"""Logistic heads fitted by full-batch gradient steps, each step one DataFrame aggregate.

The fit is plain relational algebra: a step scores every training row with the current weights (literals),
and one aggregate returns the gradient, ``dims + 1`` sums a candidate. Several candidates (learning
rate, regularisation) go through the same pass, so a grid costs one scan a step, not one a candidate. Rows
are featurised once and written to the shared folder; a step reads two columns and sends one row
to the driver. The same recursion can be written in SQL, which is how the coefficients are checked.

After every epoch (a number of steps) the weights are kept. ``select_epoch`` scores all of them
on the validation rows in one pass and takes the best by the positive class's F1, the earliest of equals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from ..operators.evaluate import evaluate
from ..operators.select import best_by

# numbers of an aggregate's one result row: candidates x (dimensions + 1)
MAX_SUMS = 1 << 20


@dataclass(frozen=True)
class Candidate:
    rate: float = 1.0
    l2: float = 0.0


@dataclass(frozen=True)
class Head:
    """Weights of one linear classifier; ``bias`` is not regularised."""

    weights: tuple[float, ...]
    bias: float

    def logit(self, features: Column | str) -> Column:
        x = F.col(features) if isinstance(features, str) else features
        products = F.zip_with(x, F.array(*[F.lit(w) for w in self.weights]), lambda a, b: a * b)
        return F.aggregate(products, F.lit(self.bias), lambda a, b: a + b)

    def probability(self, features: Column | str) -> Column:
        return 1 / (1 + F.exp(-self.logit(features)))


def hashed_counts(df: DataFrame, tokens_col: str, dims: int, carry: list[str]) -> DataFrame:
    """``carry..., features array<double>``: unit vectors of ``ln(1 + count)`` of the row's tokens by hash bucket.

    The bucket is the first four hex digits of the token's md5 modulo ``dims``, the same in any engine. Tokens are
    counted per row by partial aggregation, so a row crosses the shuffle as ``dims`` numbers, its text never.
    A row without tokens has the zero vector.
    """
    key, b = "_cf_row", F.col("_b")
    keyed = df.select(F.monotonically_increasing_id().alias(key), *carry, F.col(tokens_col).alias("_t"))
    bucket = (F.conv(F.substring(F.md5(F.col("_w").cast("binary")), 1, 4), 16, 10).cast("int") % dims).alias("_b")
    ex = keyed.select(key, *carry, F.explode_outer("_t").alias("_w")).select(key, *carry, bucket)
    per = ex.groupBy(key, *carry).agg(*[F.count_if(b == i).alias(f"_c{i}") for i in range(dims)])
    logs = per.select(*carry, F.array(*[F.log1p(F.col(f"_c{i}").cast("double")) for i in range(dims)]).alias("_x"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x))
    logs = logs.select(*carry, "_x", F.explode(F.array(norm)).alias("_n"))  # the norm once a row
    return logs.select(*carry, F.transform("_x", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(F.lit(0.0))).alias("features"))


def fit_epochs(train: DataFrame, candidates: list[Candidate], features_col: str = "features", label_col: str = "label_id",
               epochs: int = 3, steps: int = 10) -> list[list[Head]]:
    """Weights of every candidate after every epoch of ``steps`` full-batch gradient steps, from zero weights.

    ``train`` should be a written table (it is read once a step); rows with a null label are left out.
    """
    x, y = F.col(features_col), F.col(label_col).cast("double")
    rows = train.where(F.col(label_col).isNotNull()).select(x.alias("x"), y.alias("y"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    n, dims = shape["n"], shape["most"]
    if not n:
        raise ValueError("no training rows")
    if shape["least"] != dims:
        raise ValueError("feature vectors differ in length")
    if len(candidates) * (dims + 1) > MAX_SUMS:
        raise ValueError(f"candidates x (dimensions + 1) must not exceed {MAX_SUMS}")
    heads = [[0.0] * (dims + 1) for _ in candidates]
    kept: list[list[Head]] = [[] for _ in candidates]
    for step in range(1, epochs * steps + 1):
        # weights are array literals: the generated code stays the same from step to step
        parts = [_gap_times_row(Head(tuple(w[:-1]), w[-1])).alias(f"g{c}") for c, w in enumerate(heads)]
        sums = [Summarizer.metrics("sum").summary(F.col(f"g{c}")).getField("sum") for c in range(len(heads))]
        row = rows.select(*parts).agg(*[vector_to_array(v).alias(f"s{c}") for c, v in enumerate(sums)]).first()  # one row
        for c, (cand, w) in enumerate(zip(candidates, heads, strict=True)):
            heads[c] = [
                v - cand.rate * (row[f"s{c}"][i] / n + (cand.l2 * v if i < dims else 0.0)) for i, v in enumerate(w)
            ]
            if step % steps == 0:
                kept[c].append(Head(tuple(heads[c][:-1]), heads[c][-1]))
    return kept


def _gap_times_row(head: Head) -> Column:
    """A row's part of the gradient, bias last: (probability - label) x features."""
    gap = head.probability("x") - F.col("y")
    return array_to_vector(let(gap, lambda r: F.concat(F.transform("x", lambda v: v * r), F.array(r))))


def fit_head(train: DataFrame, features_col: str = "features", label_col: str = "label_id", rate: float = 1.0, l2: float = 0.0,
             steps: int = 30) -> Head:
    """One head after a fixed number of steps."""
    return fit_epochs(train, [Candidate(rate, l2)], features_col, label_col, 1, steps)[0][-1]


def epoch_metrics(rows: DataFrame, heads: list[list[Head]], features_col: str = "features", label_col: str = "label_id",
                  positive: int = 1, group_cols: list[str] | None = None) -> DataFrame:
    """Metric bundle of every candidate and epoch over ``rows``, in one pass: each row is scored by all heads."""
    group_cols = list(group_cols or [])
    every = F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.lit(e).alias("epoch"), F.lit(h.bias).alias("b"), F.array(*[F.lit(w) for w in h.weights]).alias("w"))
        for c, epochs in enumerate(heads) for e, h in enumerate(epochs, 1)
    ])
    x = rows.select(*group_cols, F.col(label_col).cast("int").alias("label_id"), F.col(features_col).alias("x"), F.explode(every).alias("h"))
    z = F.aggregate(F.zip_with("x", "h.w", lambda a, b: a * b), F.col("h.b"), lambda a, b: a + b)
    scored = x.select(*group_cols, "label_id", "h.candidate", "h.epoch", (z > 0).cast("int").alias("pred_id"))
    return evaluate(scored, group_cols=[*group_cols, "candidate", "epoch"], positive=positive, classes=[0, 1])


def select_epoch(val: DataFrame, heads: list[list[Head]], features_col: str = "features", label_col: str = "label_id",
                 positive: int = 1) -> tuple[Head, DataFrame]:
    """The head of best validation F1 (ties: earlier candidate, then epoch), and all metrics with ``chosen``."""
    m = epoch_metrics(val, heads, features_col, label_col, positive)
    best = best_by(m, "f1", tie_cols=["candidate", "epoch"]).select("candidate", "epoch").collect()[0]  # one row
    chosen = (F.col("candidate") == best["candidate"]) & (F.col("epoch") == best["epoch"])
    return heads[best["candidate"]][best["epoch"] - 1], m.withColumn("chosen", chosen)
