"""Exact Jaccard self-join of word n-gram sets with adaptive multi-match prefixes.

A document's set is its distinct n-word shingles. Shingles have one order for the whole corpus, rarest
first: those whose hash cell stands out in a fixed-size count over all documents come last, the others
are ordered by the frequency of their words, then by hash. Any fixed order gives the same result; this
one keeps passages and lines that many documents share out of the prefixes. Equal sets are one node from the start (a partial aggregate by a 128-bit
fingerprint), so exact copies never meet in a join.

Two sets that overlap by the fraction ``t`` of either must share ``m`` of their first
``n - ceil(t n) + m`` shingles, for any ``m``. From the exact counts of the shortest prefixes (m = 1) the
candidates of a document are estimated, over the corpus by its size and the mean of all documents, within a block by its own
counts, and the ``m`` of least cost is taken: a longer prefix against fewer candidates to verify (``_asks``). Documents that share fewer than a similar one could ask for are set
aside. A first shingle of a few nodes gives their
pairs, and a pair counts as a candidate when it shares as many first shingles as the less demanding
side asks for. Nodes with a more common first shingle (groups of near copies, or chance) meet
another way: their sets are cut by hash into more parts than similar sets can differ in, so similar ones
have an equal part (sets that leave parts empty are cut in further ways, see ``part_signatures``), and each node is tied to the smallest node with that part (a star, not all pairs).
Components of these ties are blocks, and every similar pair lies in one: either one of its shared first
shingles is common, or all ``m`` are counted.

Within a block the same is done again with the exact counts of the block. Pairs that are already connected are
not verified again: the result is the components, for which that loses nothing. Blocks above
``MAX_BLOCK`` shingles are cut into parts, and every pair of parts is a unit of its own, so memory is
bounded for groups of near copies of any size; the links of all units meet in ``components``.

Defined cases: a null text or one without words has an empty set and no links; a text of fewer than
n words has one shingle, its whole sequence; repeated rows are equal sets; a null id gets a null
component unless linked, in which case the smallest id counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import tokens as tk
from corpusflow.llm.common import materialize, read, with_columns
from corpusflow.llm.components import components
from corpusflow.llm.suffix_dedup import LAST, prepared

#: Words and shingles are counted in so many hash cells: what is collected and shipped has this size at any scale.
CELLS = 1 << 16
SHINGLE_CELLS = 1 << 22
#: Shingles of a block (or of two parts of one) that a task holds at a time.
MAX_BLOCK = 2_000_000
#: A first shingle of up to so many nodes gives their pairs; nodes with more common ones meet by equal parts.
PAIRS_UP_TO = 16
#: Shared shingles that a document asks for at most: more than a passage of ordinary length holds, and
#: a bound on what the longest prefixes add to the shortest.
MAX_MATCHES = 64
#: Times that nodes which share too few first shingles are set aside before pairs are made.
PRUNINGS = 2


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = tk.ASCII_LOWER[data]
    start, end, row = tk.word_bounds(b, offsets)
    return tk.range_hash(tk.prefix_hash(b), start, end), row


#: Cells of a count array that travel as one row, and bins of a doubling in the histogram of counts.
PIECE, BINS = 1 << 15, 8


def _cell_counts(docs: DataFrame, k: int) -> DataFrame:
    """Counts of word and shingle cells over all documents, from one pass: (piece, body), word cells first."""
    n_words, pieces = CELLS // PIECE, (CELLS + SHINGLE_CELLS) // PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS + SHINGLE_CELLS, np.uint32)
        for _, _, _, data, offsets in tk.text_batches(batches):
            word, row = _words(data, offsets)
            shingle = tk.shingle_hashes(word, row, k)[0]
            for base, cells, h in ((0, CELLS, word), (CELLS, SHINGLE_CELLS, shingle)):
                at, n = np.unique((h % np.uint64(cells)).astype(np.int64), return_counts=True)
                count[base + at] += n.astype(np.uint32)
        parts = count.reshape(-1, PIECE)
        some = np.flatnonzero(parts.any(axis=1))
        for lo in range(0, len(some), 8):
            own = some[lo : lo + 8]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([parts[i].tobytes() for i in own], pa.binary())], ["piece", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, body in zip(batch.column("piece").to_pylist(), batch.column("body"), strict=True):
                total.setdefault(number, np.zeros(PIECE, np.int64))
                total[number] += np.frombuffer(body.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "body"])

    # a piece's arrays, one a task of the scan, meet in one task and are added up as they come
    sent = docs.select("text").mapInArrow(run, "piece long, body binary")
    summed = sent.repartition(min(64, pieces), "piece").mapInArrow(add, "piece long, body binary")
    return materialize(summed, "join_cells").withColumn("of_words", F.col("piece") < n_words)


@dataclass
class Order:
    """The corpus order of shingles: what stands out as frequent last, the others by their words."""

    words: np.ndarray  # log frequency of each word cell, 0 to 28
    often: np.ndarray  # per shingle cell: 0, or how far above the usual count it is (log scale, 1 to 100)


def corpus_order(docs: DataFrame, k: int) -> Order:
    """From counts of fixed size: the driver gets a small histogram, the word cells and one byte a shingle cell."""
    cells = _cell_counts(docs, k)
    words = np.zeros(CELLS, np.int64)
    for r in cells.where("of_words").collect():
        words[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(bytes(r["body"]), np.int64)
    log = np.clip(np.log2(np.maximum(words, 1)) - np.log2(max(words.sum(), 1)) + 28, 0, 28).astype(np.float32)
    shingles = cells.where("NOT of_words").select((F.col("piece") - CELLS // PIECE).alias("piece"), "body")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                at, n = np.unique(np.floor(BINS * np.log2(np.frombuffer(body.as_py(), np.int64) + 1.0)).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["bin", "n"])

    found = sorted((r["bin"], r["n"]) for r in shingles.mapInArrow(bins, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect())
    # the usual count of a cell: the median, to the width of a bin (cells of pieces that nobody sent are empty)
    half, usual = SHINGLE_CELLS // 2 - (SHINGLE_CELLS - sum(n for _, n in found)), 0.0
    for at, n in found:
        if half < 0:
            break
        half, usual = half - n, 2.0 ** (at / BINS) - 1

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column("body"):
                above = np.frombuffer(body.as_py(), np.int64) - usual - 4 * np.sqrt(usual + 1)
                out.append(np.where(above > 0, np.clip(1 + 4 * np.log2(np.maximum(above, 1)), 1, 100), 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(out, pa.binary())], ["piece", "body"])

    often = np.zeros(SHINGLE_CELLS, np.uint8)
    for r in shingles.mapInArrow(levels, "piece long, body binary").toLocalIterator():
        often[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(bytes(r["body"]), np.uint8)
    return Order(log, often)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row in the corpus order (as sorted 64-bit ids) and the rows' bounds in them."""
    rows = len(offsets) - 1
    word, row = _words(data, offsets)
    h, at = tk.shingle_hashes(word, row, k)
    heavy = order.words[(word % np.uint64(CELLS)).astype(np.int64)] if len(word) else np.zeros(0, np.float32)
    weight = sum((heavy[at + j] for j in range(k)), np.zeros(len(at), np.float32)) * (120 / (28 * k))
    often = order.often[(h % np.uint64(SHINGLE_CELLS)).astype(np.int64)]
    rank = np.where(often > 0, 120 + often.astype(np.int64), np.clip(weight, 0, 120).astype(np.int64)).astype(np.uint64)
    owner = row[at] if len(at) else at
    n = np.bincount(row, minlength=rows)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.searchsorted(row, few)
        whole = np.zeros(len(few), np.uint64)
        for i, (r, f) in enumerate(zip(few, first, strict=True)):
            x = np.zeros(1, np.uint64) + np.uint64(n[r])
            for w in word[f : f + n[r]]:
                x = tk.mix64(x * np.uint64(0x9E3779B97F4A7C15) + w)
            whole[i] = x[0]
        h, owner, rank = np.concatenate([h, whole]), np.concatenate([owner, few]), np.concatenate([rank, np.zeros(len(few), np.uint64)])
    ident = (rank << np.uint64(56)) | (h >> np.uint64(8))
    by = np.lexsort((ident, owner))
    owner, ident = owner[by], ident[by]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (ident[1:] != ident[:-1])]) if len(ident) else np.zeros(0, bool)
    owner, ident = owner[new], ident[new]
    return ident, np.searchsorted(owner, np.arange(rows + 1))


def _need(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n with any similar one."""
    return -(-(n * percent) // 100)


def node_table(docs: DataFrame, k: int, percent: int, order: Broadcast) -> DataFrame:
    """doc_id, o, k, n, fingerprint (f1, f2) and the first shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in tk.text_batches(batches):
            ident, bound = shingle_sets(data, offsets, k, order.value)
            n = np.diff(bound)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(tk.mix64(ident + np.uint64(c)))]) for c in (1, 7)]
            f1, f2 = ((s[bound[1:]] - s[bound[:-1]]).view(np.int64) for s in sums)
            spare = n - _need(n, percent)
            length = np.minimum(spare + np.minimum(spare + 1, MAX_MATCHES), n)  # the longest prefix a document may take
            at = np.repeat(bound[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ident[at].view(np.int64)))
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("o"), own.column("k"), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(spare.astype(np.int32)), prefix],
                ["doc_id", "o", "k", "n", "f1", "f2", "spare", "prefix"],
            )

    return docs.select("doc_id", "o", "k", "text").mapInArrow(run, "doc_id long, o long, k long, n long, f1 long, f2 long, spare int, prefix array<long>")


def part_signatures(ident: np.ndarray, bound: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of the parts of each set, such that similar sets have an equal part.

    Two similar sets of at most ``hi`` shingles differ in at most ``d`` of them, so of ``d + 1`` parts by hash
    at least one is the same in both. It may be empty, unless either set fills all parts: sets that leave one
    empty are cut into four times as many parts too, where ``d + 1`` filled ones are enough, and those that do
    not even fill these have each shingle as a part. Sizes fall into classes of a fixed ratio; a set also stands
    in the next class if it can be similar to a larger set there.
    """
    n, ratio = np.diff(bound), 105 / percent  # similar sizes differ by less than the ratio of the classes
    size_class = np.floor(np.log(np.maximum(n, 1)) / np.log(ratio) + 1e-9).astype(np.int64)
    rows, signs = [], []
    for step in (0, 1):
        c = size_class + step
        low = np.floor(ratio**c)
        use = np.flatnonzero((n > 0) & ((step == 0) | (100 * n >= percent * low)))
        for cut, times in enumerate((1, 4, 0)):
            if not len(use):
                break
            high = np.ceil(ratio ** (c[use] + 1)) + 1
            least = (np.floor(2 * high * (100 - percent) / (100 + percent)) + 1).astype(np.int64)
            at = np.repeat(bound[use], n[use]) + np.arange(n[use].sum()) - np.repeat(np.cumsum(n[use]) - n[use], n[use])
            owner = np.repeat(np.arange(len(use)), n[use])
            h = tk.mix64(ident[at] + np.uint64(11 + cut))
            parts = (times * least).astype(np.uint64)
            part = h % parts[owner] if times else h
            by = np.lexsort((part, owner))
            owner, part, h = owner[by], part[by], tk.mix64(h[by])
            head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
            total = np.add.reduceat(h, head)
            rows.append(use[owner[head]])
            signs.append(tk.mix64(total + tk.mix64(part[head] * np.uint64(512) + c[use][owner[head]].astype(np.uint64)) + np.uint64(cut)))
            use = use[np.bincount(owner[head], minlength=len(use)) < least]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(signs)


def equal_parts(docs: DataFrame, nodes: DataFrame, k: int, percent: int, order: Broadcast) -> DataFrame:
    """nodes: node, o, k -> node, sign of the parts of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in tk.text_batches(batches):
            row, sign = part_signatures(*shingle_sets(data, offsets, k, order.value), percent)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row + lo)), pa.array(sign.view(np.int64))], ["node", "sign"])

    return docs.select("o", "k", "text").join(nodes.hint("shuffle_hash"), ["o", "k"]).select("node", "text").mapInArrow(run, "node long, sign long").distinct()


def _asks(n: int, spare: int, shared: float) -> int:
    """How many shared shingles to ask for: ``m`` of least ``m + n * shared / m``.

    Every further match costs one more posting; ``shared`` others' postings in the shortest prefix make at
    most ``shared / m`` candidates with ``m`` matches, and verifying one reads n shingles.
    """
    return int(min(max(round((n * shared) ** 0.5), 1), spare + 1, max(n - spare, 1), MAX_MATCHES))


def link_unit(ids: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the similar documents of a unit (a spanning forest of its similar pairs).

    ``part`` is 0 or 1: with two parts present, only pairs across them are looked at.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, part, sets = ids[order], part[order], [sets[i] for i in order]
    across = len(set(part.tolist())) > 1
    size = np.array([len(s) for s in sets])
    token, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bound = np.concatenate([[0], np.cumsum(size)])
    wants = np.zeros(len(sets), np.int64)
    post_token, post_doc, prefixes = [], [], []
    for i in range(len(sets)):
        own = inverse[bound[i] : bound[i + 1]]
        own = own[np.lexsort((own, df[own]))]  # rarest in this block first
        need = int(_need(int(size[i]), percent))
        spare = int(size[i]) - need
        wants[i] = _asks(int(size[i]), spare, float((df[own[: spare + 1]] - 1).sum()))
        own = own[: size[i] - need + wants[i]]
        own = own[df[own] > 1]
        prefixes.append(own)
        post_token.append(own)
        post_doc.append(np.full(len(own), i))
    post_token, post_doc = np.concatenate(post_token), np.concatenate(post_doc)
    by = np.argsort(post_token, kind="stable")
    post_doc = post_doc[by]
    head = np.searchsorted(post_token[by], np.arange(len(token) + 1))
    label = np.arange(len(sets))
    links: list[tuple[int, int]] = []
    smallest = np.searchsorted(size, _need(size, percent))  # first document long enough for each
    for i in range(len(sets)):
        own = prefixes[i]
        if not len(own):
            continue
        near = np.concatenate([post_doc[head[t] : head[t + 1]] for t in own])
        near = near[(near < i) & (near >= smallest[i])]
        if not len(near):
            continue
        doc, shared = np.unique(near, return_counts=True)
        ok = (shared >= np.minimum(wants[i], wants[doc])) & (label[doc] != label[i])
        if across:
            ok &= part[doc] != part[i]
        doc = doc[ok]
        while len(doc):
            some = doc[:64]
            joined = np.concatenate([sets[j] for j in some])
            at = np.searchsorted(sets[i], joined)
            at[at == size[i]] = 0
            both = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            hit = some[100 * both >= percent * (size[some] + size[i] - both)]
            for j in hit:
                if label[j] != label[i]:
                    links.append((int(ids[i]), int(ids[j])))
                    low, high = sorted((label[j], label[i]))
                    label[label == high] = low
            doc = doc[64:]
            doc = doc[label[doc] != label[i]]
    return links


def _link_units(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Units come in a row (sorted by key); each is linked when its last document is in."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, docs = None, {}

    def done() -> pa.RecordBatch:
        links = []
        if len(docs) > 1:
            ids = np.array(list(docs), np.int64)
            links = link_unit(ids, np.array([docs[x][0] for x in docs]), [docs[x][1] for x in docs], percent)
        return pa.RecordBatch.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]}, schema)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "i", "j", "part", "node")]
        bodies = batch.column("body")
        for at, (block, i, j, part, node) in enumerate(zip(*columns, strict=True)):
            if (block, i, j) != key:
                if docs:
                    yield done()
                key, docs = (block, i, j), {}
            docs[node] = (part, np.frombuffer(bodies[at].as_py(), np.uint64))
    if docs:
        yield done()


def classes(docs: DataFrame, k: int, percent: int, max_block: int = MAX_BLOCK) -> DataFrame:
    """docs: doc_id, text, o, k (see ``prepared``) -> doc_id, o, k, n, class, smallest (order id) per row.

    Two documents link when ``100 * intersection >= percent * union`` of their k-word shingle sets.
    """
    order = docs.sparkSession.sparkContext.broadcast(corpus_order(docs, k))
    rows = materialize(node_table(docs, k, percent, order), "join_rows")
    nodes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("o", "k", "n", "spare", "prefix")).alias("x"))
    # a node's name is a number of its own in the written table: ids may be null or repeat with other texts
    nodes = materialize(nodes.select("f1", "f2", "x.*").withColumn("node", F.monotonically_increasing_id()), "join_nodes")

    # the shortest prefixes: a node that shares none of its shingles there is similar to no other
    first = nodes.select("node", F.explode(F.slice("prefix", F.lit(1), F.col("spare") + 1)).alias("token"))
    often = first.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    cost = materialize(first.join(often, "token").groupBy("node").agg(F.sum(F.col("c") - 1).alias("shared")), "join_cost")
    shared = cost.agg(F.avg("shared")).first()[0] or 0.0

    def asks(n: Column) -> Column:
        """``_asks`` as a column, of the size alone, so that similar documents ask for similar numbers."""
        spare = F.floor(n * (100 - percent) / 100)
        return F.least(F.greatest(F.round(F.sqrt(n * F.lit(float(shared)))), F.lit(1)), spare + 1, F.greatest(n - spare, F.lit(1)), F.lit(MAX_MATCHES)).cast("int")

    # lengthened prefixes; a node that shares fewer of their shingles than the smallest document similar to it
    # would ask for has no partner, and without it others' shingles become rare
    first = nodes.join(cost, "node").select("node", "n", asks(F.col("n")).alias("asks"), "spare", "prefix")
    first = first.select("node", "n", "asks", F.explode(F.slice("prefix", F.lit(1), F.col("spare") + F.col("asks"))).alias("token"))
    least = asks(F.ceil(F.col("n") * percent / 100))
    for step in range(PRUNINGS):
        often = first.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        common = materialize(first.join(often, "token"), f"join_common_{step}")
        stays = common.groupBy("node", "n").agg(F.count("*").alias("has")).where(F.col("has") >= least).select("node")
        first = common.drop("c").join(stays, "node")

    # ties through what is left
    often = first.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    common = materialize(first.join(often, "token"), "join_common")
    crowded = common.where(F.col("c") > PAIRS_UP_TO).select("node").distinct()
    crowded = nodes.select("node", "o", "k").join(crowded, "node")
    parts = materialize(equal_parts(docs, crowded, k, percent, order), "join_parts")
    least = parts.groupBy("sign").agg(F.min("node").alias("m"), F.count("*").alias("c")).where("c > 1").select("sign", "m")
    star = parts.join(least, "sign").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    # rare shingles: pairs, of which each must share as many as the less demanding of the two asks for
    few = common.where(F.col("c") <= PAIRS_UP_TO).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "asks"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, PAIRS_UP_TO), lambda q: F.struct(p["node"].alias("a"), q["node"].alias("b"), F.least(p["asks"], q["asks"]).alias("asks")))))
    pair = few.select(F.explode(pairs).alias("y")).groupBy("y.a", "y.b", "y.asks").count().where("count >= asks").select("a", "b")
    ties = star.unionByName(pair)
    blocks = components(ties).withColumnRenamed("component", "block")

    # the sets of tied nodes; a block above the bound is cut into parts, and its pairs of parts are units
    member = materialize(nodes.select("node", "o", "k", "n").join(blocks, "node"), "join_members")
    parts = member.groupBy("block").agg(F.ceil(2 * F.sum("n") / F.lit(max_block)).cast("int").alias("parts"))
    unit = member.join(parts, "block").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    unit = unit.withColumn("q", other).select(
        "o", "k", "node", "block", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("part")
    )
    per_doc = unit.groupBy("o", "k", "node").agg(F.collect_list(F.struct("block", "i", "j", "part")).alias("units"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in tk.text_batches(batches):
            ident, bound = shingle_sets(data, offsets, k, order.value)
            sets = [ident[bound[r] : bound[r + 1]].tobytes() for r in range(hi - lo)]
            own = batch.slice(lo, hi - lo)
            units = own.column("units")
            at = np.repeat(np.arange(hi - lo), units.value_lengths().to_numpy(zero_copy_only=False))
            flat = units.flatten()
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(c) for c in ("block", "i", "j", "part")), own.column("node").take(pa.array(at)), pa.array([sets[r] for r in at], pa.binary())],
                ["block", "i", "j", "part", "node", "body"],
            )

    wanted = docs.select("o", "k", "text").join(per_doc.hint("shuffle_hash"), ["o", "k"]).select("node", "text", "units")
    sets = wanted.mapInArrow(bodies, "block long, i int, j int, part int, node long, body binary")
    dealt = sets.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    links = dealt.mapInArrow(lambda it: _link_units(it, percent), "a long, b long")
    links = materialize(links, "join_links")  # written first: one Python worker a task
    order.destroy()  # nothing after this reads texts
    found = components(links)

    named = nodes.select("f1", "f2", "node", "o").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("o").alias("smallest"))
    named = named.select("f1", "f2", "c").join(least, "c")
    out = rows.join(named, ["f1", "f2"], "left")
    some = F.col("n") > 0  # an empty set has no class
    return out.select("doc_id", "o", "k", "n", F.when(some, F.col("c")).alias("class"), F.when(some, F.col("smallest")).alias("smallest"))


def join(documents: DataFrame, k: int, percent: int, max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id linked) for every row of documents (doc_id, text)."""
    c = classes(prepared(documents), k, percent, max_block)
    component = F.coalesce(F.when(F.col("smallest") < LAST, F.col("smallest")), "doc_id")
    return c.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(documents: DataFrame, k: int, percent: int, max_block: int = MAX_BLOCK) -> DataFrame:
    """The rows of documents without those similar to one that stays: of each class the smallest id stays."""
    docs = prepared(documents)
    rows = materialize(classes(docs.select("doc_id", "text", "o", "k"), k, percent, max_block), "join_classes")
    stays = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("o", "k")).alias("x")).select("x.o", "x.k")
    stays = stays.unionByName(rows.where(F.col("class").isNull()).select("o", "k").distinct())
    out = docs.join(stays.hint("shuffle_hash"), ["o", "k"], "left_semi")
    if rows.where(F.col("class").isNotNull()).groupBy("o", "k").count().where("count > 1").limit(1).count():
        # repeated rows of one text are one class: only one of them stays
        out = out.where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).unionByName(
            out.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).dropDuplicates(["o", "k"])
        )
    return out.select(documents.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_columns(read(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    return join(docs, 3, 90)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
