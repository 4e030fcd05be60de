"""Exact removal of repeated byte strings with a distributed suffix order.

Every byte of a ``length``-byte string that also starts earlier in the corpus (smaller id, or same
document and earlier start) is removed. Sorting all suffixes of the corpus would move every byte many
times; only suffixes that can have an equal need to be ordered, and they are found like this:

1. *Runs.* Each string holds ``length - GRAM + 1`` grams of ``GRAM`` bytes; the gram of least hash is
   its anchor, the leftmost of equals. Equal strings have equal anchors at equal offsets. Neighbouring
   starts with the same anchor form a run (about 30 starts), so a text of n bytes has about n/30 runs.
2. *Shared anchors.* Runs are counted by anchor (map-side partial sums, so a common anchor is one row
   a task) and joined back; runs whose anchor occurs once cannot repeat and are done. The join is on a
   plain equi-key, which adaptive execution splits where an anchor is common.
3. *Equal runs.* Runs with the same anchor and a 128-bit fingerprint are equal; all but the first go.
4. *Suffix order.* What is left are first runs whose anchor has several different runs: the edges of
   repeated passages. Their bytes are brought together by anchor, and in each block the suffixes at
   all their starts are put in deep-shallow order (see ``suffixes``); equal neighbours form classes,
   and all but a class's first start go. An anchor with more than ``HOT`` different runs is split:
   its starts go one by one to as many parts as needed, by a hash of their ``length`` bytes, so equal
   strings still meet and no part grows with the corpus.
5. *Cutting.* Removed starts are merged into byte ranges per document and cut out.

Defined cases: a null text counts as empty; a null id comes after all others; rows that share an id
count as one document (their strings are compared by start); repeated rows each give a row with the
same result; texts shorter than ``length`` keep everything; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import tokens as tk
from corpusflow.llm.common import materialize, read, with_columns
from corpusflow.llm.suffixes import equal_suffixes, padded

LENGTH = 100
GRAM = 40
#: Different runs of one anchor that are ordered together; beyond it the anchor is split.
HOT = 4_096
#: Bytes of runs ordered together in one go within a task.
BLOCK_BYTES = 1 << 21
LAST = (1 << 63) - 1


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first start in the row, number of starts, anchor hash and fingerprint of each run."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = tk.prefix_hash(data)
    s = np.arange(len(data) - gram + 1)
    gram_hash = tk.range_hash(prefix, s, s + gram)
    # the place in the low bits: the leftmost of equal grams wins, and the minimum tells where it is
    bits = np.uint64(int(len(s)).bit_length())
    least = tk.sliding_min((gram_hash >> bits << bits) | s.astype(np.uint64), length - gram + 1)
    least = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = np.flatnonzero(row[: len(least)] == row[length - 1 :])
    if not len(ok):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = least[ok]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    first = ok[head]
    n = np.diff(np.append(head, len(ok)))
    at = row[first]
    return at, first - offsets[at], n, gram_hash[anchor[head]], tk.range_hash(prefix, first, first + n - 1 + length)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: o (order id), k (text hash), text -> anchor, print, o, k, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, data, offsets in tk.text_batches(batches):
            row, start, n, anchor, mark = _runs(data, offsets, length, gram)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(mark), batch.column("o").take(at), batch.column("k").take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "print", "o", "k", "start", "n"],
            )

    return docs.select("o", "k", "text").mapInArrow(run, "anchor long, print long, o long, k long, start int, n int")


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int, hot: int) -> DataFrame:
    """The bytes of the wanted runs, each with the part that orders it; split anchors go start by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, o, k, start, body = [], [], [], [], [], []
            ids, kinds = batch.column("o").to_pylist(), batch.column("k").to_pylist()
            texts = batch.column("text")
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text = texts[i].as_py().encode()
                for x in spans:
                    s, n, a = x["start"], x["n"], x["anchor"]
                    if x["different"] <= hot:
                        part.append(a), key.append(0), o.append(ids[i]), k.append(kinds[i]), start.append(s), body.append(text[s : s + n - 1 + length])
                    else:
                        parts = -(-x["different"] * 32 // hot)
                        for j in range(s, s + n):
                            w = text[j : j + length]
                            mark = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                            part.append(a), key.append(1 + mark % parts), o.append(ids[i]), k.append(kinds[i]), start.append(j), body.append(w)
                if len(body) >= 20_000:
                    yield pa.RecordBatch.from_pydict({"anchor": part, "part": key, "o": o, "k": k, "start": start, "body": body}, schema)
                    part, key, o, k, start, body = [], [], [], [], [], []
            yield pa.RecordBatch.from_pydict({"anchor": part, "part": key, "o": o, "k": k, "start": start, "body": body}, schema)

    schema = pa.schema([("anchor", pa.int64()), ("part", pa.int64()), ("o", pa.int64()), ("k", pa.int64()), ("start", pa.int32()), ("body", pa.binary())])
    per_doc = wanted.groupBy("o", "k").agg(F.collect_list(F.struct("start", "n", "anchor", "different")).alias("spans"))
    j = docs.select("o", "k", "text").join(per_doc.hint("shuffle_hash"), ["o", "k"])
    # rows that repeat a document would only repeat its runs, which changes no class
    return j.mapInArrow(run, "anchor long, part long, o long, k long, start int, body binary")


def _order(block: list[tuple], length: int) -> pa.RecordBatch:
    """Starts of a block that are not the first of their class, as ranges of starts."""
    text, at = padded([b[5] for b in block], length)
    size = np.diff(at)
    n = size - length + 1
    owner = np.repeat(np.arange(len(block)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    o = np.array([b[2] for b in block], np.int64)[owner]
    k = np.array([b[3] for b in block], np.int64)[owner]
    start = np.array([b[4] for b in block], np.int64)[owner] + inner
    member, number = equal_suffixes(text, at[owner] + inner, length)
    order = np.lexsort((start[member], o[member], number))
    member, number = member[order], number[order]
    head = np.concatenate([[True], number[1:] != number[:-1]])
    first = member[np.flatnonzero(head)][np.cumsum(head) - 1] if len(member) else member
    gone = member[(o[member] != o[first]) | (start[member] != start[first])]
    return _ranges(o[gone], k[gone], start[gone])


def _ranges(o: np.ndarray, k: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, k, o))
    o, k, start = o[order], k[order], start[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1]) | (start[1:] > start[:-1] + 1)]) if len(o) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(o))[: len(head)] - 1  # without starts there is no range either
    return pa.RecordBatch.from_arrays(
        [pa.array(o[head]), pa.array(k[head]), pa.array(start[head].astype(np.int32)), pa.array((start[last] - start[head] + 1).astype(np.int32))],
        ["o", "k", "start", "n"],
    )


def _order_parts(bodies: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Order the suffixes of each part; whole parts are taken together up to a block's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = [], 0, None
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= block_bytes and x[:2] != last:
                    yield _order(block, length)
                    block, held = [], 0
                last = x[:2]
                block.append(x)
                held += len(x[5])
        if block:
            yield _order(block, length)

    dealt = bodies.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, "o long, k long, start int, n int")


def removed_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: o, k, text -> ranges of starts (o, k, start, n) whose strings also start earlier."""
    runs = find_runs(docs, length, gram)
    often = runs.groupBy("anchor").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("anchor")
    # written first: a join of two plain exchanges, which adaptive execution can split at a hot anchor
    often = materialize(often, "suffix_often")
    shared = materialize(runs.join(often, "anchor"), "suffix_shared")
    place = F.struct("o", "start")
    kinds = shared.groupBy("anchor", "print").agg(F.min(F.struct("o", "start", "k", "n")).alias("first"))
    kinds = materialize(kinds, "suffix_kinds")
    again = shared.join(kinds, ["anchor", "print"]).where(place > F.struct("first.o", "first.start"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > 1)
    several = materialize(several, "suffix_several")
    edges = kinds.join(several, "anchor").select("anchor", "different", "first.*")
    by_order = _order_parts(_cut_out(docs, edges, length, hot), length)
    return again.select("o", "k", "start", "n").unionByName(by_order)


def prepared(documents: DataFrame) -> DataFrame:
    """Adds the order id ``o`` (null last) and the text hash ``k`` to documents."""
    d = documents.withColumn("o", F.coalesce("doc_id", F.lit(LAST)))
    return d.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with the named columns, kept bytes as ``text`` too.

    ``keep``: columns of documents to carry; with "text" among them the kept bytes come back as text
    (bytes that a cut left as no whole character are dropped).
    """
    d = prepared(documents)
    gone = removed_starts(d, length, gram, hot).groupBy("o", "k").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    gone = materialize(gone, "suffix_gone")
    carry = [f for f in documents.schema.fields if f.name in keep and f.name not in ("doc_id", "text")]
    give_text = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("gone")
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
            for i, text in enumerate(batch.column("text")):
                body = (text.as_py() or "").encode()
                ranges = sorted((x["start"], x["start"] + x["n"] - 1 + length) for x in (spans[i].as_py() or []))
                kept, at, n_spans = [], 0, 0
                for s, e in ranges:
                    if s > at or not n_spans:
                        kept.append(body[at:s])
                        n_spans += 1
                    at = max(at, e)
                kept.append(body[at:])
                rest = b"".join(kept)
                out["n_bytes"].append(len(body))
                out["n_removed"].append(len(body) - len(rest))
                out["n_spans"].append(n_spans)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if give_text:
                    out["kept_text"].append(text.as_py() if not n_spans else rest.decode("utf-8", "ignore"))
            cols = [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if give_text:
                cols.append(pa.array(out["kept_text"], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(f.name) for f in carry)], [*names, *(f.name for f in carry)])

    j = d.select("o", "k", "doc_id", "text", *[f.name for f in carry]).join(gone.hint("shuffle_hash"), ["o", "k"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if give_text else "")
    return j.mapInArrow(run, schema + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carry))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(with_columns(read(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"}))
