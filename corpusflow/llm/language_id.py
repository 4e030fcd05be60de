"""Language identification by a blended-spectrum string kernel.

Two texts are as similar as the weighted number of byte 1-, 2- and 3-grams that both hold (presence,
not counts), normalised. A few landmark texts per language stand for the training set (Nystrom), and
one-versus-rest kernel ridge regression on them gives one score per language. Documents are scored in
batches: a presence matrix times the landmarks' n-grams times the ridge weights, two matrix products.

The model is fitted on a bounded sample of the training rows: about ``PER_LANGUAGE`` rows of each
language, drawn by a hash of the id; only their packed presence bits reach the driver. The model (a
few megabytes, fixed by its parameters) goes with the tasks. Scoring reads every whole text once and
shuffles nothing.

Defined cases: a null text or one without any letter gives ``und`` with score 0; a null language is
never learned; if no row can be learned from, everything is ``und``; repeated rows each give a row;
an empty table gives an empty result; columns other than doc_id, text and lang are ignored.
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
#: Bounds of the training sample and of the model.
PER_LANGUAGE = 600
MAX_ROWS = 24_000
MAX_LANGUAGES = 2_000
LANDMARKS_PER_LANGUAGE = 24
MAX_LANDMARKS = 400
#: n-gram length -> (bits of its hash space, weight in the kernel)
BLEND = {1: (8, 0.25), 2: (12, 0.5), 3: (14, 1.0)}
WIDTH = sum(1 << bits for bits, _ in BLEND.values())
RIDGE = 1e-3
SEED = 7

#: Letters in lower case, everything else of ASCII a space.
_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLDED[0x80:] = np.arange(0x80, 0x100)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix (rows x WIDTH) of the n-grams each text holds."""
    rows = len(offsets) - 1
    out = np.zeros((rows, WIDTH), np.uint8)
    if not len(data):
        return out
    b = _FOLDED[data]
    # capital accented Latin letters: second byte after 0xC3
    upper = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)
    b[1:][upper] += 0x20
    row = np.repeat(np.arange(rows), np.diff(offsets))
    flat, base = out.reshape(-1), 0
    code = b.astype(np.uint32)
    for n, (bits, _) in BLEND.items():
        if n > 1:
            code = code[:-1] * np.uint32(256) + b[n - 1 :]
            same = row[: len(code)] == row[n - 1 :]
            key = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            flat[(row[: len(code)][same] * WIDTH + base) + key[same]] = 1
        else:
            flat[row * WIDTH + base + code] = 1
        base += 1 << bits
    return out


def weights() -> np.ndarray:
    return np.concatenate([np.full(1 << bits, w, np.float32) for bits, w in BLEND.values()])


@dataclass
class LanguageModel:
    """Landmark n-grams (already weighted and normalised), ridge weights, languages."""

    landmarks: np.ndarray  # WIDTH x m
    ridge: np.ndarray  # m x languages
    languages: list[str]

    def kernel(self, x: np.ndarray) -> np.ndarray:
        xf = x.astype(np.float32)
        own = np.sqrt(np.maximum(xf @ weights(), 1e-9))
        return (xf @ self.landmarks) / own[:, None]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.ridge


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, data, offsets in tk.text_batches(batches):
        bits = np.packbits(presence(data, offsets), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "bits"])


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> LanguageModel | None:
    """Fit on a bounded sample of (doc_id, text, lang); None without any language.

    Every language is learned, from about ``per_language`` rows or its share of ``MAX_ROWS`` if there are many, and from its
    row of least hash in any case; more than ``MAX_LANGUAGES`` values are an error.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    found = train.groupBy("lang").agg(F.count("*").alias("n"), F.min(key).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if not found:
        return None
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    per_language = max(2, min(per_language, MAX_ROWS // len(found)))
    bounds = [(r["lang"], min(1.0, per_language / r["n"]) * (1 << 20), r["least"]) for r in found]
    drawn = train.sparkSession.createDataFrame(bounds, "lang string, cut double, least long")  # a row a language
    rows = train.join(F.broadcast(drawn), "lang").where((F.pmod(key, F.lit(1 << 20)) < F.col("cut")) | (key == F.col("least")))
    rows = bounded_sample(rows.select("doc_id", "text", "lang"), 2 * MAX_ROWS, seed).select("lang", "text")
    got = rows.mapInArrow(_presence_rows, "lang string, bits binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    lang = np.array([r["lang"] for r in got])
    bits = np.stack([np.frombuffer(bytes(r["bits"]), np.uint8) for r in got])
    languages = sorted(set(lang.tolist()))
    rng = np.random.default_rng(seed)
    each = max(2, min(LANDMARKS_PER_LANGUAGE, MAX_LANDMARKS // len(languages)))
    picked = np.concatenate([rng.permutation(np.flatnonzero(lang == c))[:each] for c in languages])
    w = weights()
    z = np.unpackbits(bits[picked], axis=1)[:, :WIDTH].astype(np.float32)
    z = (z * w) / np.sqrt(np.maximum(z @ w, 1e-9))[:, None]
    model = LanguageModel(np.ascontiguousarray(z.T), np.zeros((len(picked), len(languages)), np.float32), languages)
    k = np.concatenate([model.kernel(np.unpackbits(bits[i : i + 128], axis=1)[:, :WIDTH]) for i in range(0, len(bits), 128)]).astype(np.float64)
    # Nystrom: features k(x, landmarks) K_mm^(-1/2), ridge on them
    kmm = k[picked]
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-6)))
    phi = k @ root
    y = (lang[:, None] == np.array(languages)[None, :]).astype(np.float64)
    share_of = y.sum(0)
    row_weight = (len(y) / len(languages) / share_of)[y.argmax(1)]
    a = (phi * row_weight[:, None]).T
    solved = np.linalg.solve(a @ phi + RIDGE * len(y) * np.eye(phi.shape[1]), a @ y)
    model.ridge = (root @ solved).astype(np.float32)
    return model


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; texts without an ASCII letter are looked at as Unicode."""
    rows = len(offsets) - 1
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    count = np.concatenate([[0], np.cumsum(letter)])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    assert len(out) == rows
    return out


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in tk.text_batches(batches):
            label, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
            known = _has_letter(data, offsets)
            if model is not None and known.any():
                names = np.array(model.languages, object)
                for i in range(0, hi - lo, 256):
                    o = offsets[i : i + 257]
                    s = model.scores(presence(data[o[0] : o[-1]], o - o[0]))
                    best = s.argmax(1)
                    label[i : i + len(best)] = names[best]
                    score[i : i + len(best)] = np.clip(s.max(1), 0, 1)
                label[~known], score[~known] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(label, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    d = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    d = with_columns(documents, {"doc_id": "long", "text": "string", "lang": "string"})
    train = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return predict(d, fit(train))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
