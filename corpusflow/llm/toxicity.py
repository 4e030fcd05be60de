"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of itself and its character 3- to 5-grams (hashed, with borders), so
an unseen misspelling shares vectors with the word it comes from. A window of ``WINDOW`` words is
the mean of its words, a linear softmax scores the window, and a document takes the score of its most
toxic window: a few insults in a long text must not be averaged away. Embeddings and softmax are
trained together by Adam, first on means of whole documents, then on the most toxic window.

The training set is a bounded sample of labelled rows of the training folds (about ``PER_CLASS`` of
each class, texts of at most ``MAX_TRAIN_CHARS`` characters). As the model is linear behind the
averages, it is shipped as one number per n-gram bucket (fixed size). Scoring reads every whole text
once, in Arrow batches, and shuffles nothing.

Defined cases: a null or blank text has no window and gets the score of the bias alone; without both
classes in the training folds every score is 0; a null label is no label, several labels of an id
count as the largest; repeated rows each give a row; an empty table gives an empty result; other
columns are ignored.
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

FOLDS, HELD_OUT = 4, 2
CUT = 0.3
PER_CLASS = 3_000
MAX_TRAIN_CHARS = 8_000
BUCKET_BITS = 18
GRAMS = (3, 4, 5)
DIM = 8
WINDOW = 12
SEED = 13
BATCH = 128
WARM_EPOCHS, EPOCHS, MIN_STEPS = 3, 18, 200

_BREAKS = tk.SPACES.copy()
_BREAKS[[ord(c) for c in ".,;:!?()[]{}\"'|/\\<>"]] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1."""
    b = tk.ASCII_LOWER[data]
    if len(b) > 1:
        upper = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][upper] += 0x20
    return b


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and word number of each row's distinct words, in order; and start and end of each distinct word."""
    start, end, row = tk.word_bounds(data, offsets, _BREAKS)
    h = tk.range_hash(tk.prefix_hash(data), start, end)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    # a word counts once a document, where it stands first: runs of one word must not fill a window
    _, once = np.unique(row * np.int64(len(first)) + number, return_index=True)
    once.sort()
    return row[once], number[once], start[first], end[first]


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of the given words, and the number of the word; words in order."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.empty(at[-1], np.uint8)
    word = np.repeat(np.arange(n), size)
    inner = np.arange(at[-1]) - at[word] - 1
    border = (inner < 0) | (inner == size[word] - 2)
    text[border] = np.where(inner[border] < 0, 0x3C, 0x3E)
    text[~border] = data[start[word[~border]] + inner[~border]]
    prefix = tk.prefix_hash(text)
    buckets, owners = [], []
    for g in GRAMS:
        s = np.flatnonzero(word[: len(text) - g + 1] == word[g - 1 :]) if len(text) >= g else np.zeros(0, np.int64)
        buckets.append(tk.range_hash(prefix, s, s + g) >> np.uint64(64 - BUCKET_BITS))
        owners.append(word[s])
    buckets.append(range_of_words(prefix, at) >> np.uint64(64 - BUCKET_BITS))
    owners.append(np.arange(n))
    b, o = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def range_of_words(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each whole word with its borders, apart from those of n-grams."""
    return tk.mix64(tk.range_hash(prefix, at[:-1], at[1:]) + np.uint64(1))


def _window_means(score: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest mean of a window of words per row, and the window's first word and length."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[0.0], np.cumsum(score)])
    width = np.minimum(n, WINDOW)
    place = np.arange(len(score)) - first[row]
    ok = place <= n[row] - width[row]
    s = np.flatnonzero(ok)
    mean = (total[s + width[row[s]]] - total[s]) / np.maximum(width[row[s]], 1)
    best, at = np.zeros(rows), np.zeros(rows, np.int64)
    if len(s):
        order = np.lexsort((mean, row[s]))
        last = np.flatnonzero(np.append(row[s][order][1:] != row[s][order][:-1], True))
        who = row[s][order][last]
        best[who], at[who] = mean[order][last], s[order][last]
    return best, at, width


@dataclass
class ToxicityModel:
    bucket: np.ndarray  # per n-gram bucket: how far it moves the softmax towards "toxic"
    bias: float
    offset: float  # log odds of the true class share over the balanced sample's

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        b = fold_case(data)
        rows = len(offsets) - 1
        row, number, start, end = distinct_words(b, offsets)
        grams, owner = subwords(b, start, end)
        per = np.bincount(owner, self.bucket[grams], len(start)) / np.maximum(np.bincount(owner, minlength=len(start)), 1)
        best, _, _ = _window_means(per[number], row, rows)
        return 1 / (1 + np.exp(-(best + self.bias + self.offset).clip(-40, 40)))


class _Adam:
    """Adam on the touched rows of each parameter."""

    def __init__(self, *params: np.ndarray, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, *grads: tuple[np.ndarray | slice, np.ndarray]) -> None:
        self.t += 1
        for p, (at, g), m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            p[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.999**self.t)) + 1e-8)


class _Batch:
    """A fixed set of training documents with its words and n-grams laid out for forward and backward sums."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        data = fold_case(np.frombuffer(b"".join(texts), np.uint8))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.rows, self.y = len(texts), labels.astype(np.float32)
        self.row, self.number, start, end = distinct_words(data, offsets)
        grams, self.owner = subwords(data, start, end)
        self.touched, self.gram = np.unique(grams, return_inverse=True)
        self.n_words = len(start)
        self.per_word = np.maximum(np.bincount(self.owner, minlength=self.n_words), 1).astype(np.float32)
        self.heads = _run_heads(self.owner)
        self.by_gram = np.argsort(self.gram, kind="stable")
        self.gram_heads = _run_heads(self.gram[self.by_gram])
        self.n = np.maximum(np.bincount(self.row, minlength=self.rows), 1)
        self.place = np.arange(len(self.row))


def _run_heads(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) if len(x) else np.zeros(0, np.int64)


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Joint training; returns the collapsed bucket scores and the bias of "toxic" over "not"."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    batches = [_Batch([texts[i] for i in part], labels[part]) for part in np.array_split(order, max(1, len(order) // BATCH))]
    batches = [b for b in batches if len(b.gram)]
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.zeros(1 << BUCKET_BITS, bool)
    adam = _Adam(emb, soft, bias, rate=0.05)
    everything = slice(None)
    epochs = max(EPOCHS, -(-MIN_STEPS // max(1, len(batches))))
    for epoch in range(WARM_EPOCHS + epochs):
        adam.rate = 0.05 if epoch < WARM_EPOCHS + epochs // 2 else 0.02
        for k in rng.permutation(len(batches)):
            b = batches[k]
            seen[b.touched] = True
            words = np.zeros((b.n_words, DIM), np.float32)
            words[b.owner[b.heads]] = np.add.reduceat(emb[b.touched[b.gram]], b.heads, axis=0)
            words /= b.per_word[:, None]
            u = soft[:, 1] - soft[:, 0]
            scalar = words @ u
            if epoch < WARM_EPOCHS:  # mean of the whole document, scaled
                z = np.bincount(b.row, scalar[b.number], b.rows) / np.sqrt(b.n)
                share = (1 / np.sqrt(b.n))[b.row]
            else:
                z, at, width = _window_means(scalar[b.number], b.row, b.rows)
                inside = (b.place >= at[b.row]) & (b.place < (at + width)[b.row])
                share = np.where(inside, 1 / np.maximum(width[b.row], 1), 0)
            p = 1 / (1 + np.exp(-(z + bias[1] - bias[0]).clip(-40, 40)))
            dz = ((p - b.y) / b.rows).astype(np.float32)
            dscalar = np.bincount(b.number, dz[b.row] * share, b.n_words).astype(np.float32)
            dwords = (dscalar / b.per_word)[:, None] * u[None, :]
            demb = np.add.reduceat(dwords[b.owner[b.by_gram]], b.gram_heads, axis=0) + 1e-7 * emb[b.touched]
            du, db = words.T @ dscalar, float(dz.sum())
            adam.step((b.touched, demb), (everything, np.stack([-du, du], 1) + 1e-5 * soft), (everything, np.array([-db, db], np.float32)))
    bucket = np.zeros(1 << BUCKET_BITS, np.float32)
    bucket[seen] = emb[seen] @ (soft[:, 1] - soft[:, 0])
    return bucket, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> ToxicityModel | None:
    trained = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    known = labels.where(trained & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().where(F.col("label").isin(0, 1)).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("label") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)
    ids = F.broadcast(known.where(F.col("label").isin(0, 1) & drawn).limit(4 * per_class).withColumnRenamed("doc_id", "l_id"))  # bounded
    rows = docs.join(ids, F.col("doc_id") == F.col("l_id")).where(F.length("text") <= MAX_TRAIN_CHARS)
    rows = bounded_sample(rows.select("doc_id", "text", "label"), 4 * per_class, seed)
    got = sorted((r["label"], r["text"].encode()) for r in rows.select("label", "text").collect())
    y = np.array([label for label, _ in got])
    if not len(y) or y.min() == y.max():
        return None
    bucket, bias = train([t for _, t in got], y, seed)
    true, drawn_share = counts[1] / (counts[0] + counts[1]), y.mean()
    offset = float(np.log(true / (1 - true)) - np.log(drawn_share / (1 - drawn_share)))
    return ToxicityModel(bucket, bias, offset)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in tk.text_batches(batches):
            p = model.score(data, offsets).astype(float) if model else np.zeros(hi - lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    d = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    d = with_columns(documents, {"doc_id": "long", "text": "string"})
    known = with_columns(labels, {"doc_id": "long", "toxic": "int"}).withColumnRenamed("toxic", "label")
    return score(d, fit(d, known))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
