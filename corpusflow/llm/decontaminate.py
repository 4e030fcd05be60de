"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every test item is cut into word n-grams, and all of them are its seeds: an edited or partial copy may
hold any of them, and none of the rarer ones. A document that holds a seed
is joined to the item there: seed hits on near diagonals make a passage, widened by the item's length
and some slack, and passage and item are aligned by words (Smith-Waterman, linear gaps). The score is
that of the best local alignment over that of the whole item aligned to itself, so copies that were
edited or paraphrased in part still count. An alignment matches each word of the item once at most, so a
passage that lacks the words for the threshold (most chance hits of a common n-gram) is not aligned.

The items are the bounded side of the join: up to ``MAX_GRAMS`` n-grams go with the tasks at a time;
a larger benchmark is split into shards of that size, each scanned on its own (exact at any size).
Documents are read once a shard and never shuffled. Equal passages are aligned once a span of texts.

Defined cases: null texts on either side hold no words; items of fewer than ``SEED_WORDS`` words
have no seed and are never reported (a word or two stand in clean texts too); an item without id is
reported with a null; repeated rows of documents each give their rows, repeated items
(same id and text) give one; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import tokens as tk
from corpusflow.llm.common import read, with_columns

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -2, -2
THRESHOLD = 0.4
MAX_GRAMS = 2_000_000
_FILTER_BITS = 20

_BREAKS = tk.SPACES.copy()
_BREAKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: runs without space or ASCII punctuation, A-Z in lower case."""
    b = tk.ASCII_LOWER[data]
    start, end, row = tk.word_bounds(b, offsets, _BREAKS)
    return tk.range_hash(tk.prefix_hash(b), start, end), row


@dataclass
class Items:
    """A shard of the benchmark: word hashes of its items, and its n-grams sorted by hash."""

    ids: np.ndarray
    words: list[np.ndarray]
    gram: np.ndarray  # distinct n-gram hashes, sorted
    head: np.ndarray  # bounds of each n-gram's places
    item: np.ndarray  # per place: item number
    at: np.ndarray  # per place: word position in the item

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        ids = np.array([r[0] for r in rows], object)
        bodies = [r[1].encode() for r in rows]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        word, row = hashed_words(data, offsets)
        bound = np.searchsorted(row, np.arange(len(rows) + 1))
        h, at = tk.shingle_hashes(word, row, SEED_WORDS)
        order = np.argsort(h, kind="stable")
        gram, head = np.unique(h[order], return_index=True)
        item = row[at][order]
        return cls(ids, [word[bound[i] : bound[i + 1]] for i in range(len(rows))], gram, np.append(head, len(h)), item, at[order] - bound[item])

    def lookup(self) -> np.ndarray:
        """A table that tells quickly that a hash is no n-gram of the shard."""
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[(self.gram & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return out

    def find(self, h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that hold an n-gram of the shard, and its number."""
        near = np.flatnonzero(table[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        number = np.searchsorted(self.gram, h[near])
        number[number == len(self.gram)] = 0
        ok = self.gram[number] == h[near] if len(self.gram) else np.zeros(len(near), bool)
        return near[ok], number[ok]


def shards(benchmark: DataFrame, max_grams: int = MAX_GRAMS) -> Iterator[Items]:
    """The benchmark in shards of at most about ``max_grams`` words."""
    b = benchmark.where(F.col("text").isNotNull()).distinct()
    words = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(words) // (2 * max_grams)))  # a word is two characters at least, with its gap
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        found = [(r["item_id"], r["text"]) for r in b.where(part == i).collect()]
        rows = sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Items.of(rows)


def align(passages: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score and end of each passage against its item; pairs are run side by side."""
    out = np.zeros((len(passages), 2), np.int64)
    order = sorted(range(len(passages)), key=lambda i: (len(others[i]), len(passages[i])))
    for lo in range(0, len(order), 256):
        some = order[lo : lo + 256]
        m, w = max(len(others[i]) for i in some), max(len(passages[i]) for i in some)
        a, b = np.zeros((len(some), m), np.uint64), np.ones((len(some), w), np.uint64)  # 0 and 1 never match
        for r, i in enumerate(some):
            a[r, : len(others[i])], b[r, : len(passages[i])] = others[i], passages[i]
        ramp = -GAP * np.arange(w + 1, dtype=np.int32)
        above = np.zeros((len(some), w + 1), np.int32)
        best, end = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for j in range(m):
            here = np.zeros_like(above)
            np.maximum(above[:, :-1] + np.where(b == a[:, j : j + 1], MATCH, MISMATCH).astype(np.int32), above[:, 1:] + GAP, out=here[:, 1:])
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps along the passage
            top = here.max(axis=1)
            better = top > best
            if better.any():
                best[better] = top[better]
                end[better] = here[better].argmax(axis=1)
            above = here
        out[some, 0], out[some, 1] = best, end
    return out


def _passages(hit: np.ndarray, number: np.ndarray, row: np.ndarray, bound: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Row, item, first and last word of each passage: seed hits of a row and item on near diagonals."""
    times = np.diff(items.head)[number]
    at = np.repeat(items.head[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    word, item = np.repeat(hit, times), items.item[at]
    r, diagonal = row[word], word - items.at[at]
    order = np.lexsort((diagonal, item, r))
    r, item, diagonal = r[order], item[order], diagonal[order]
    size = np.array([len(x) for x in items.words])
    slack = size[item] // 4 + 4
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(r)) - 1
    r, item, slack = r[head], item[head], slack[head]
    first = np.maximum(diagonal[head] - slack, bound[r])
    return r, item, first, np.minimum(diagonal[last] + size[item] + slack, bound[r + 1])


def _able(word: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, items: Items, threshold: float) -> np.ndarray:
    """Whether each passage holds enough words of its item for the threshold: what is left out cannot reach it."""
    out = np.zeros(len(item), bool)
    order = np.argsort(item, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]]))
    for lo, hi in zip(head, np.append(head[1:], len(order)), strict=True):
        some, own = order[lo:hi], items.words[item[order[lo]]]
        value, times = np.unique(own, return_counts=True)
        n = last[some] - first[some]
        owner = np.repeat(np.arange(len(some)), n)
        body = word[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        number = np.minimum(np.searchsorted(value, body), len(value) - 1)
        ok = value[number] == body
        held = np.unique(owner[ok] * np.int64(len(value)) + number[ok])
        matches = np.bincount(held // len(value), times[held % len(value)], len(some))
        out[some] = matches >= threshold * len(own) - 1e-9
    return out


def _leaks(data: np.ndarray, offsets: np.ndarray, items: Items, table: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Row, item, score, first and last word of the best passage of each row and item, for a span of texts."""
    word, row = hashed_words(data, offsets)
    h, at = tk.shingle_hashes(word, row, SEED_WORDS)
    hit, number = items.find(h, table)
    if not len(hit):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), none, none
    size = np.array([len(x) for x in items.words])
    bound = np.searchsorted(row, np.arange(len(offsets)))
    r, item, first, last = _passages(at[hit], number, row, bound, items)
    # equal passages are aligned once
    able = _able(word, item, first, last, items, threshold)
    r, item, first, last = r[able], item[able], first[able], last[able]
    if not len(r):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), none, none
    passages = [word[s:e] for s, e in zip(first, last, strict=True)]
    where: dict[tuple[int, bytes], int] = {}
    which = np.array([where.setdefault((int(i), p.tobytes()), len(where)) for i, p in zip(item, passages, strict=True)])
    _, some = np.unique(which, return_index=True)
    found = align([passages[x] for x in some], [items.words[item[x]] for x in some])[which]
    score = found[:, 0] / (MATCH * size[item])
    order = np.lexsort((first, -score, item, r))
    top = order[np.concatenate([[True], (r[order][1:] != r[order][:-1]) | (item[order][1:] != item[order][:-1])])]
    top = top[score[top] >= threshold]
    return r[top], item[top], score[top], first[top] - bound[r[top]], first[top] + found[top, 1] - bound[r[top]]


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_grams: int = MAX_GRAMS) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: passages that align with an item."""
    docs = with_columns(documents, {"doc_id": "long", "text": "string"})
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"

    def scan(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = items.lookup()
            for batch, lo, _, data, offsets in tk.text_batches(batches):
                r, item, score, first, last = _leaks(data, offsets, items, table, threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(r + lo)), pa.array(items.ids[item], pa.int64()), pa.array(score), pa.array(first), pa.array(last)],
                    ["doc_id", "item_id", "score", "first_word", "last_word"],
                )

        return docs.mapInArrow(run, schema)

    out = None
    for items in shards(with_columns(benchmark, {"item_id": "long", "text": "string"}), max_grams):
        out = scan(items) if out is None else out.unionByName(scan(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The rows of documents that hold no leak, whole and unshuffled."""

    def scan(docs: DataFrame, items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = items.lookup()
            for batch, lo, hi, data, offsets in tk.text_batches(batches):
                clean = np.ones(hi - lo, bool)
                clean[_leaks(data, offsets, items, table, threshold)[0]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    out = documents
    for items in shards(with_columns(benchmark, {"item_id": "long", "text": "string"}), max_grams):
        out = scan(out, items)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
