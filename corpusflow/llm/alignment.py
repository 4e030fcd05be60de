"""Alignment of two tokenizers over a corpus, each distinct text once.

Byte offsets at which a token of both vocabularies ends cut a text's two token sequences into groups; all
tokens of a group are linked. What the corpus says about a pair of ids is in how many documents
it is linked. The stages:

1. *Distinct texts.* Documents are grouped by their full text, with partial sums before the shuffle, so a text
   with a third of all documents is one row a task. Each distinct text goes on with its number of copies.
2. *Tokens and groups.* A task takes blocks of whole texts (``BLOCK_BYTES``, or one longer text), encodes them
   with both libraries, and finds groups, links and their multiplicities in flat arrays. A block
   writes one row a text, in which its distinct pairs are places in the block's dictionary of pairs, and one
   row for the dictionary itself, with the number of documents (copies included) of each pair.
3. *Counts.* The dictionaries' rows are summed by pair; an id's highest count is one row per id of the first vocabulary.
4. *Back.* Each dictionary entry is joined with its count. This is as many rows as the blocks have distinct
   pairs, far fewer than the texts have links, and a pair that stands in every text is one row a block.
   Blocks and their entries are then brought together by block, which is bounded, and summed by text.
5. *Documents* take the measures of their text by a SHA-256 key of it.

Neither the pairs nor their counts are ever held as a whole; the tables that are broadcast are the two tokenizer
files and the highest counts, bounded by the files' size and the first vocabulary.

Defined cases: null and empty texts, and texts that either vocabulary does not give back byte for byte, have
no tokens: all measures are 0 and the digest is empty; the latter hold no pair and count for none; rows that
repeat an id or a text each give a row and each count as a document; other columns are ignored; an empty
table gives an empty result. A group of n and m tokens is kept as its distinct pairs with multiplicities.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import tokens as tk
from corpusflow.llm.common import materialize, read, with_columns
from corpusflow.llm.word_bpe import byte_characters, tokenizer_file

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, links of a group from which distinct pairs are formed first, and the largest model file.
BLOCK_BYTES, WIDE, MOST_FILE_BYTES = 2 << 20, 4_096, 64 << 20
#: Fixed value: how byte-level vocabularies part a text before their merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def model_file(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MOST_FILE_BYTES + 1)
    if len(content) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return content


class Aligner:
    """Both tokenizers as tables; built once in each worker."""

    def __init__(self, content_a: str, content_b: bytes):
        self.content_a, self.content_b = content_a, content_b

    @cached_property
    def byte_level(self):
        """The first tokenizer. Its vocabulary's ids are the ranks of its merges, so the faster library can run it."""
        import tiktoken

        t = json.loads(self.content_a)
        rule, model = t["pre_tokenizer"], t["model"]
        if t["normalizer"] or (rule["type"], rule["add_prefix_space"], rule["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError("not a byte-level BPE tokenizer file of the known kind")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {a["id"] for a in t["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if i not in special}
        merged = ["".join(x) if isinstance(x, list) else x.replace(" ", "", 1) for x in model["merges"]]
        of = [model["vocab"][w] for w in merged]
        if any(a >= b for a, b in zip(of, of[1:])):
            raise ValueError("the vocabulary's ids do not follow its merges")
        return tiktoken.Encoding("aligned", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.content_b)

    @cached_property
    def bytes_a(self) -> np.ndarray:
        e = self.byte_level
        out = np.full(e.max_token_value + 1, b"", object)
        for w, i in e._mergeable_ranks.items():
            out[i] = w
        return out

    @cached_property
    def bytes_b(self) -> np.ndarray:
        p = self.pieces
        own = [bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
        return np.array(own, object)

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))

    @cached_property
    def written(self) -> np.ndarray:
        """Ids in decimal with what may follow: first ids with , and |, then second ids with , and ; and nothing."""
        a, b = [str(i).encode() for i in range(len(self.bytes_a))], [str(i).encode() for i in range(len(self.bytes_b))]
        return np.array([*(x + b"," for x in a), *(x + b"|" for x in a), *(x + b"," for x in b), *(x + b";" for x in b), *b], object)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's ids end, for both; texts that do not come back have none."""
        a = [np.asarray(self.byte_level.encode_ordinary(" " + t), np.int64) for t in texts]
        b = [np.asarray(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)] if texts else []
        for i, text in enumerate(texts):
            want = (" " + text).encode()
            if not text or b"".join(self.bytes_a[a[i]]) != want or b"".join(self.bytes_b[b[i]]) != want:
                a[i] = b[i] = np.zeros(0, np.int64)
        none = [np.zeros(0, np.int64)]
        ends = [np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b)]
        return np.concatenate(none + a), ends[0], np.concatenate(none + b), ends[1]

    def align(self, texts: list[str], copies: np.ndarray) -> dict[str, np.ndarray | list]:
        """Measures and distinct pairs of each text of a block, and the block's dictionary of pairs."""
        a, a_end, b, b_end = self.encode(texts)
        n = len(texts)
        size_a, size_b = self.sizes
        at_a, at_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        both = np.zeros(int(at_a[-1]) + 1 if len(a) else 1, bool)
        ends_b = np.zeros(len(both), bool)
        both[at_a] = True
        ends_b[at_b] = True
        both &= ends_b
        before = np.cumsum(both) - both
        group_a, group_b = before[at_a], before[at_b]
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text_a = np.repeat(np.arange(n), np.diff(a_end, prepend=0))
        group_text = text_a[first_a]
        links = in_a * in_b

        # the written form: first ids of a group, then its second ids
        nothing = len(self.bytes_a), len(self.bytes_b)
        last_a = np.concatenate([group_a[1:] != group_a[:-1], [True]])[: len(a)]
        last_b = np.concatenate([group_b[1:] != group_b[:-1], [True]])[: len(b)]
        final = np.zeros(len(b), bool)
        final[b_end[b_end > np.concatenate([[0], b_end[:-1]])] - 1] = True
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + first_b[group_a]] = a + nothing[0] * last_a
        line[np.arange(len(b)) + (first_a + in_a)[group_b]] = 2 * nothing[0] + b + nothing[1] * (last_b.astype(np.int64) + final)
        line_end = a_end + b_end
        digests, lo = [], 0
        for hi in line_end.tolist():
            digests.append(hashlib.sha256(b"".join(self.written[line[lo:hi]])).hexdigest() if hi > lo else "")
            lo = hi

        # distinct pairs of each text with their numbers of links
        span = nothing[0] * nothing[1]
        usual = np.flatnonzero(links <= WIDE)
        m, g = links[usual], np.repeat(usual, links[usual])
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        keys = group_text[g] * span + a[first_a[g] + inner // in_b[g]] * nothing[1] + b[first_b[g] + inner % in_b[g]]
        keys, times = np.unique(keys, return_counts=True)
        wide = np.flatnonzero(links > WIDE)
        if len(wide):
            more_keys, more_times = [keys], [times]
            for w in wide.tolist():
                ua, ca = np.unique(a[first_a[w] : first_a[w] + in_a[w]], return_counts=True)
                ub, cb = np.unique(b[first_b[w] : first_b[w] + in_b[w]], return_counts=True)
                more_keys.append((group_text[w] * span + ua[:, None] * nothing[1] + ub).ravel())
                more_times.append((ca[:, None] * cb).ravel())
            keys, same = np.unique(np.concatenate(more_keys), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, same, np.concatenate(more_times))
            times = total
        owner, pair = keys // span, keys % span
        pairs, place = np.unique(pair, return_inverse=True)
        held = np.bincount(place, weights=copies[owner], minlength=len(pairs)).astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
        return {
            "n_a": np.diff(a_end, prepend=0), "n_b": np.diff(b_end, prepend=0), "n_groups": np.bincount(group_text, minlength=n),
            "n_links": np.bincount(group_text, weights=links, minlength=n).astype(np.int64), "groups_sha256": digests,
            "pair_end": np.cumsum(np.bincount(owner, minlength=n)), "place": place, "times": times,
            "a": pairs // nothing[1], "b": pairs % nothing[1], "held": held,
        }


_built: dict[int, Aligner] = {}


def _aligner(content: tuple[str, bytes]) -> Aligner:
    key = hash(content)
    if key not in _built:
        _built[key] = Aligner(*content)
    return _built[key]


def text_sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _blocks(texts: DataFrame, content, block_bytes: int) -> DataFrame:
    """texts: key, text, copies -> a row a text and a row a block's dictionary (key null)."""
    measures = ["n_a", "n_b", "n_groups", "n_links"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [("block", pa.int64()), ("key", pa.binary()), *((m, pa.int64()) for m in measures), ("groups_sha256", pa.string())]
    schema = pa.schema([*kinds, ("place", ints), ("times", longs), ("a", ints), ("b", ints), ("held", longs)])

    def lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = tk.text_bytes(batch.column("text"))
            for lo, hi, _, _ in tk.spans(np.zeros(0, np.uint8), offsets, block_bytes):
                part, n = batch.slice(lo, hi - lo), hi - lo
                x = _aligner(content.value).align(part.column("text").to_pylist(), part.column("copies").to_numpy())
                columns = [pa.array(np.full(n, block)), part.column("key"), *(pa.array(x[m]) for m in measures), pa.array(x["groups_sha256"], pa.string())]
                columns += [lists(x["pair_end"], x["place"], pa.int32()), lists(x["pair_end"], x["times"], pa.int64()), *(pa.nulls(n, k) for k in (ints, ints, longs))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                end = np.array([len(x["a"])])
                columns = [pa.array([block]), *(pa.nulls(1, k) for _, k in kinds[1:]), pa.nulls(1, ints), pa.nulls(1, longs)]
                columns += [lists(end, x["a"], pa.int32()), lists(end, x["b"], pa.int32()), lists(end, x["held"], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                block += 1

    spark_schema = "block long, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place array<int>, times array<long>, a array<int>, b array<int>, held array<long>"
    return texts.select("key", "text", "copies").mapInArrow(run, spark_schema)


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's texts with the counts of its dictionary: links at their id's highest count, and counts over all links."""
    n = np.zeros(right.num_rows, np.int64)
    best = np.zeros(right.num_rows, bool)
    at = right.column("entry").to_numpy()
    n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
    flat = lambda c: left.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    place, times = flat("place"), flat("times")
    size = np.fromiter((len(x) for x in left.column("place")), np.int64, left.num_rows)
    end = np.cumsum(size)
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], end])])
    out = left.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    out = out.append_column("n_best", pa.array(total(times * best[place])))
    return out.append_column("count_sum", pa.array(total(times * n[place])))


def _counted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionaries' entries (block, entry, a, b, held), and each pair's count with whether it is its first id's highest."""
    entries = blocks.where("key IS NULL").select("block", F.posexplode(F.arrays_zip("a", "b", "held")).alias("entry", "x")).select("block", "entry", "x.*")
    n = materialize(entries.groupBy("a", "b").agg(F.sum("held").alias("n")), "align_counts")
    highest = n.groupBy("a").agg(F.max("n").alias("highest"))  # one row per id of the first vocabulary at most
    counts = n.join(F.broadcast(highest), "a").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))
    return entries, counts


def _prepared(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers

    d = with_columns(docs, {"doc_id": "long", "text": "string"})
    files = tokenizer_file(path_a or public_tokenizers.path(FILE_A)), model_file(path_b or public_tokenizers.path(FILE_B))
    content = docs.sparkSession.sparkContext.broadcast(files)
    texts = d.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select(text_sha(F.col("text")).alias("key"), "text", "copies")
    return d, materialize(_blocks(texts, content, block_bytes), "align_blocks")


def pair_counts(docs: DataFrame, path_a: str = "", path_b: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (whether n is the highest of a)."""
    return _counted(_prepared(docs, path_a, path_b, block_bytes)[1])[1]


def measures(docs: DataFrame, path_a: str = "", path_b: str = "", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    d, blocks = _prepared(docs, path_a, path_b, block_bytes)
    entries, counts = _counted(blocks)
    found = entries.select("block", "entry", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "entry", "n", "best")
    texts = blocks.where("key IS NOT NULL").drop("a", "b", "held")
    schema = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    of_text = texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_summed, schema)
    of_text = materialize(of_text, "align_measures")
    j = d.select("doc_id", F.when(F.col("text") != "", text_sha(F.col("text"))).alias("key")).join(of_text, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return j.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(read(spark, sf_dir, "documents"))
