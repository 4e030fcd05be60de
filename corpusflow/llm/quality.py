"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled 1 in the training folds; the unlabelled set is web text drawn
from the training folds without looking at labels. A linear model on statistics of the whole text
minimises the non-negative unbiased risk
``prior * R(pos, +) + max(0, R(unlabelled, -) - prior * R(pos, -))`` with the logistic loss, by
gradient steps in numpy; when the second part turns negative, its gradient is reversed. The class
prior is estimated from positives and unlabelled rows too (``estimate_prior``): labels of 0 are never looked at.

Positives and unlabelled rows are bounded samples (``MAX_POSITIVES``, ``MAX_UNLABELLED``) drawn by a
hash of the id, each (id, text) once and bounded as rows; only their fixed-width statistics reach the driver. Scoring reads every whole text
once, in Arrow batches, and shuffles nothing.

Defined cases: null and blank texts are scored as empty texts; without any positive every score is
the prior; a null label is no label, several labels of an id count as the smallest; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import tokens as tk
from corpusflow.llm.common import bounded_sample, fold, read, with_columns

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 6_000
SEED = 11
STEPS = 600

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _distinct_per_row(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the largest number of times one occurs."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(r)))
    most = np.zeros(rows)
    np.maximum.at(most, r[at], times)
    return np.bincount(r[at], minlength=rows).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: shares of bytes, and shapes of words, lines and repeats, of whole texts."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    shares = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256) / np.maximum(size, 1)[:, None]
    prefix = tk.prefix_hash(data)
    start, end, row = tk.word_bounds(data, offsets)
    words = tk.range_hash(prefix, start, end)
    n = np.bincount(row, minlength=rows).astype(float)
    per = np.maximum(n, 1)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, rows) / per
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / per - mean**2, 0))
    kinds, most = _distinct_per_row(row, words, rows)
    three, at = tk.shingle_hashes(words, row, 3)
    kinds3, most3 = _distinct_per_row(row[at], three, rows)
    n3 = np.maximum(np.bincount(row[at], minlength=rows), 1)
    ls, le, lr = tk.word_bounds(data, offsets, _NEWLINE)
    lines = np.bincount(lr, minlength=rows)
    line_kinds, _ = _distinct_per_row(lr, tk.range_hash(prefix, ls, le), rows)
    has3 = n >= 3
    follows = np.flatnonzero((row[1:] == row[:-1]) & (words[1:] == words[:-1]))
    again = np.bincount(row[follows], minlength=rows)  # words equal to the one before
    shape = [
        np.log1p(n), np.log1p(size), mean / 10, spread / 10, np.where(n > 0, kinds / per, 1), np.where(n > 0, most / per, 0),
        np.where(has3, kinds3 / n3, 1), np.where(has3, most3 / n3, 0), np.log1p(lines), lines / per,
        np.where(lines > 0, line_kinds / np.maximum(lines, 1), 1), (n < 5).astype(float), again / per,
    ]
    return np.concatenate([np.sqrt(shares), np.stack(shape, 1)], axis=1).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative positive-unlabelled risk (logistic loss, Adam)."""
    w = np.zeros(pos.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (pos, unl))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = (p @ w).clip(-40, 40), (u @ w).clip(-40, 40)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        positive = -prior * (p.T @ (1 - sp)) / len(p)
        as_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = positive + as_negative if risk >= 0 else -as_negative
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled, from positives and unlabelled rows alone.

    Above any score cut, unlabelled rows are at least the prior times as frequent as positives, and about that where the
    cut keeps few negatives: the least ratio over the cuts is the estimate. Each half of the rows is scored by a
    model of the other half, since a model scores its own positives too high, which would make the ratio too small.
    """
    ratios = []
    for half in (0, 1) if min(len(pos), len(unl)) >= 4 else (None,):
        fitted, scored = ((x[half::2] if half is not None else x for x in (pos, unl)), (x[1 - half :: 2] if half is not None else x for x in (pos, unl)))
        w, b = nn_pu(*fitted, 0.5, steps=150)
        sp, su = (np.sort(x @ w + b) for x in scored)
        cuts = np.quantile(sp, np.linspace(0.05, 0.5, 20))
        above = lambda s: 1 - np.searchsorted(s, cuts) / len(s)  # noqa: B023, E731
        ratios.append(above(su) / np.maximum(above(sp), 1e-6))
    return float(np.clip(np.mean(ratios, axis=0).min(), 0.05, 0.95))


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, data, offsets in tk.text_batches(batches):
        x = statistics(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label").slice(lo, hi - lo), batch.column("unlabelled").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())],
            ["label", "unlabelled", "x"],
        )


def fit(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED, seed: int = SEED) -> QualityModel | None:
    """docs: doc_id, text; labels: doc_id, label. Both restricted to the training folds here."""
    trained = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    known = labels.where(trained & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    n_pos = known.where("label = 1").count()
    if not n_pos:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20))
    sampled = known.where((F.col("label") == 1) & (draw < min(1.0, positives / n_pos) * (1 << 20))).limit(2 * positives)
    n_docs = docs.where(trained).count()
    other = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(1 << 20)) < min(1.0, unlabelled / max(n_docs, 1)) * (1 << 20)
    # at most 2 * positives ids: a bounded side, so it may be broadcast
    ids = F.broadcast(sampled.select(F.col("doc_id").alias("l_id"), "label"))
    rows = docs.where(trained).join(ids, F.col("doc_id") == F.col("l_id"), "left").withColumn("unlabelled", other)
    rows = rows.where(F.col("unlabelled") | (F.col("label") == 1)).select("doc_id", "label", "unlabelled", "text")
    rows = bounded_sample(rows, 2 * (positives + unlabelled), seed).select("label", "unlabelled", "text")
    got = rows.mapInArrow(_statistics_rows, "label int, unlabelled boolean, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: bytes(r["x"]))  # the order of rows must not depend on the tasks
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in got]).astype(np.float64)
    is_pos = np.array([r["label"] == 1 for r in got])
    is_unl = np.array([bool(r["unlabelled"]) for r in got])
    if not is_pos.any() or not is_unl.any():
        return None
    mean, scale = x[is_unl].mean(0), x[is_unl].std(0) + 1e-3
    z = ((x - mean) / scale).clip(-8, 8)
    prior = estimate_prior(z[is_pos], z[is_unl])
    w, b = nn_pu(z[is_pos], z[is_unl], prior)
    return QualityModel(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), b, prior)


def score(docs: DataFrame, model: QualityModel | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the named columns of docs carried along."""
    fields = [f for f in docs.schema.fields if f.name in keep and f.name != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in tk.text_batches(batches):
            p = model.score(statistics(data, offsets)).astype(float) if model else np.full(hi - lo, 0.5)
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("held_out"), pa.array(p), pa.array((p >= CUT).astype(np.int32)), *(own.column(f.name) for f in fields)],
                ["doc_id", "held_out", "score", "predicted", *[f.name for f in fields]],
            )

    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    d = docs.select("doc_id", held_out, "text", *[f.name for f in fields if f.name != "text"])
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + more)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    d = with_columns(documents, {"doc_id": "long", "text": "string"})
    known = with_columns(labels, {"doc_id": "long", "quality": "int"}).withColumnRenamed("quality", "label")
    return score(d, fit(d, known))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
