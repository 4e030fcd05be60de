"""The trie of all conversations' prefixes, from whole sequences.

Conversations are many and mostly alike at their start; a cache of prefixes wants to know which prefixes are
shared by how many, and how much text they save. Nothing walks a trie here:

1. *Order.* Turns are ordered by one range partitioning of (conversation, turn) and running counts over it
   (``running``), so a conversation of any length lies in as many tasks as it needs. Texts are replaced by a
   128-bit digest of (role, text) and a number of bytes before anything moves.
2. *Fingerprints.* Each turn is hashed with its place, and the running sums of two such 64-bit hashes name
   each prefix. The sums at a conversation's last turn name its whole sequence.
3. *Whole sequences.* Equal sequences are one row with their number (weight), least id and end list. All
   that follows looks at one conversation of each sequence, so copies cost nothing further.
4. *Nodes.* The prefixes of the distinct sequences are summed up by fingerprint (map-side first, so the root and
   a common opening are one row a task). A node belongs to the sequence of its least id; along a sequence
   the nodes that it owns are the last ones, from depth ``own`` on. A sequence that is no proper prefix
   of another (anti-join) ends in a leaf.
5. *Subtrees.* With ``own`` and the leaf mark, children, leaves and bytes of a node's subtree are plain sums
   over the sequences through it: each distinct node is counted by its owner, each conversation by weight.
6. *End lists* are cut into pieces of at most ``PIECE`` ids by a range partitioning of (sequence, id); one
   task then hashes a sequence's pieces in order, holding one at a time.

Joins are on plain keys, which adaptive execution splits where one is common (children of the root, a long
conversation).

Defined cases: a null role or text is empty; turns with equal numbers (or without one, which come first) are
ordered by role, then by the digest, so repeated turns stay and every run agrees; rows without ``conv_id`` belong to no
conversation and are left out; an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import blank_if_null, materialize, read, with_columns
from corpusflow.llm.running import running_sums

#: Ids of an end list that one row holds.
PIECE = 4_096
#: Fixed by the contract of op13: conversations share the opening of the first of each ``GROUP`` ids, and
#: the length of that opening is a remainder of ``OPENINGS``.
GROUP, OPENINGS = 5, 9
NODE = ["d", "f1", "f2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """c (conversation), pos (from 1), print (digest of role and text), bytes (of the text)."""
    t = with_columns(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}).where("conv_id IS NOT NULL")
    role, text = blank_if_null(F.col("role")), blank_if_null(F.col("text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    t = t.select(F.col("conv_id").alias("c"), "turn", role.alias("role"), mark.alias("print"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    t = running_sums(t, "c", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")], ["one"], "trie_turns")
    return t.select("c", F.col("sum_one").alias("pos"), "print", "bytes")


def lengths_of(turns: DataFrame) -> DataFrame:
    """c, n: the conversations with their number of turns."""
    return turns.groupBy("c").agg(F.max("pos").alias("n"))


def opening(c: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its group."""
    return F.crc32(c.cast("string").cast("binary")) % OPENINGS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with another's opening: (c, d, print, bytes, length) by turn, and (c, length) of those without a turn."""
    n = lengths_of(turns)
    c = n.select("c", "n", (F.col("c") - F.col("c") % GROUP).alias("base"), opening(F.col("c")).alias("h"))
    c = c.join(n.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
    c = c.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = c.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    c = materialize(c.select("c", "base", "h", "taken", "length"), "trie_rebuilt")
    own = turns.join(c.select("c", "h", "taken", "length"), "c").where("pos > h")
    own = own.select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "print", "bytes", "length")
    first = turns.where(F.col("pos") < OPENINGS).select(F.col("c").alias("base"), F.col("pos").alias("d"), "print", "bytes")
    first = first.join(c.where("taken > 0").select("c", "base", "taken", "length"), "base").where("d <= taken")
    return own.unionByName(first.select("c", "d", "print", "bytes", "length")), c.where("length = 0").select("c", "length")


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: c and its node -> node, ends_sha256 of the ascending ids joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for *key, c in zip(*(batch.column(x).to_pylist() for x in (*NODE, "c")), strict=True):
                if key != node or len(ids) == PIECE:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = key, []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                out = []
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, ids[0], ",".join(map(str, ids))), strict=True))], schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(last.names, x, strict=True)) for x in out], last)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(last.names, (*node, digest.hexdigest()), strict=True))], last)

    key = [(x, pa.int64()) for x in NODE]
    schema = pa.schema([*key, ("first", pa.int64()), ("ids", pa.string())])
    last = pa.schema([*key, ("ends_sha256", pa.string())])
    dealt = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    cut = dealt.mapInArrow(pieces, "d long, f1 long, f2 long, first long, ids string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "d long, f1 long, f2 long, ends_sha256 string")


def trie(steps: DataFrame, turnless: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences.

    ``steps``: c, d (place from 1), print, bytes, length (of the sequence); ``turnless``: c, length = 0.
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    steps = steps.select(
        "c", "d", "length", "bytes",
        F.xxhash64("print", "d").alias("u1"), F.xxhash64(F.lit("second"), "d", "print").alias("u2"),
    )
    sums = running_sums(steps, "c", [F.col("d")], ["u1", "u2", "bytes"], "trie_steps")
    steps = sums.select(
        "c", "d", "length", F.col("sum_u1").alias("f1"), F.col("sum_u2").alias("f2"), F.col("before_u1").alias("p1"), F.col("before_u2").alias("p2"),
        F.col("before_bytes").alias("before"), F.col("sum_bytes").alias("total"),
    )
    zero = F.lit(0).cast("long")
    none = turnless.select("c", zero.alias("d"), zero.alias("f1"), zero.alias("f2"), zero.alias("total"))
    ends = steps.where("d = length").select("c", *NODE, "total").unionByName(none)
    whole = ends.groupBy(*NODE).agg(F.count("*").alias("w"), F.min("c").alias("c"), F.min("total").alias("total"))
    whole = materialize(whole.withColumnRenamed("d", "length"), "trie_sequences")

    # one row a prefix of each distinct sequence, the root's included
    inner = steps.drop("length", "total").join(whole.select("c", "length", "w", "total"), "c")
    root = whole.select("c", "length", "w", "total", zero.alias("d"), *[zero.alias(x) for x in ("f1", "f2", "p1", "p2", "before")])
    prefixes = materialize(inner.unionByName(root), "trie_prefixes")
    owners = prefixes.groupBy(*NODE).agg(F.min("c").alias("c"), F.min("before").alias("before"), F.max(F.col("length") > F.col("d")).alias("goes_on"))
    owners = materialize(owners, "trie_owners")
    own = owners.groupBy("c").agg(F.min(F.struct("d", "before")).alias("x")).select("c", F.col("x.d").alias("own"), F.col("x.before").alias("own_before"))
    leaves = whole.select("c", F.col("length").alias("d"), "f1", "f2").join(owners.where("goes_on").select(*NODE), NODE, "left_anti")
    facts = whole.select("c").join(own, "c", "left").join(leaves.select("c", F.lit(1).cast("long").alias("leaf")), "c", "left")
    facts = materialize(facts, "trie_facts")

    p = prefixes.join(facts, "c")
    # what a sequence without a node of its own counts is nothing
    since = F.when(F.col("own").isNull(), F.col("total")).when(F.col("d") >= F.col("own"), F.col("before")).otherwise(F.col("own_before"))
    child = F.col("own").isNotNull() & (F.col("length") > F.col("d")) & (F.col("own") <= F.col("d") + 1)
    nodes = p.groupBy(*NODE).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("c").alias("conv_id"), F.sum("w").alias("n_convs"),
        F.count_if(child).alias("n_children"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"),
        (F.sum(F.col("w") * (F.col("total") - F.col("before"))) - F.sum(F.col("total") - since)).alias("saved_tokens"),
    )
    nodes = materialize(nodes, "trie_nodes")
    parent = owners.select((F.col("d") + 1).alias("d"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("c").alias("parent_conv_id"))
    nodes = nodes.join(parent, ["d", "p1", "p2"], "left").join(end_digests(ends), NODE, "left")
    return nodes.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = turns_of(conversations)
    steps = turns.join(lengths_of(turns), "c").select("c", F.col("pos").alias("d"), "print", "bytes", F.col("n").alias("length"))
    return trie(steps, lengths_of(turns).where("n = 0").select("c", F.col("n").alias("length")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns_of(read(spark, sf_dir, "conversations"))))


_BITS = "list_concat([ord(x)], [0, 0, 0, 0, 0, 0, 0])"
#: CRC-32 of a decimal, bit by bit: each byte is added before the first of its eight shifts.
_CRC = (
    f"xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: {_BITS})), "
    "lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384), 4294967295))"
)
SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, md5(concat(octet_length(encode(r)), ':', r, x))) AS own FROM t GROUP BY c),
h AS (SELECT c, own, CAST({_CRC} % {OPENINGS} AS BIGINT) AS h FROM k),
s AS (SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS q FROM h a LEFT JOIN k b ON b.c = a.c - a.c % {GROUP}),
m AS (SELECT c, q, unnest(range(len(q) + 1)) AS d FROM s),
n AS (SELECT d, q[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (len(q) = d) AS ends FROM m GROUP BY ALL),
ch AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(k[-1].x)) ELSE 0 END AS own_saved
      FROM n LEFT JOIN ch USING (d, k)),
sub AS (SELECT a AS d, k[1:a] AS k, sum(own_saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, sub.n_leaves,
       CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(f.ends, ','), '')) AS ends_sha256
FROM f JOIN sub ON sub.d = f.d AND sub.k = f.k LEFT JOIN n p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]
"""
