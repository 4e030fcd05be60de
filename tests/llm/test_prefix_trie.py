"""Operator 13 against a plain trie."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from corpusflow.llm import prefix_trie
from corpusflow.llm.running import running_sums, wrapping_add

SCHEMA = "conv_id long, turn long, role string, text string, d long, f1 long, length long, c string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _ordered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role, mark, (role, text)))
    return {c: [x[-1] for x in sorted(t)] for c, t in convs.items()}


def _rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def _nodes(convs):
    members, ends = {}, {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
        ends.setdefault(tuple(convs[c]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += children[node] == 0
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n, m in members.items()
    )


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, "x") for r in rows], SCHEMA).repartition(4)


def _both(spark, rows):
    df, convs = _frame(spark, rows), _ordered(rows)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df)))
    assert sorted(map(tuple, got.collect())) == _nodes(_rebuilt(convs))
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect())) == _nodes(convs)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(200), 60):
        for t in range(rng.randrange(1, 13)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", ""]) if t > 2 else "start"))
    rows += [(900 + i, t, "user", f"copy{t}") for i in range(0, 40, 5) for t in range(6)]
    _both(spark, rows)


def test_nulls_ties_repeats_and_a_long_conversation(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", "tie b"), (1, 0, "user", "tie a"), (1, 2, "x", None)]
    rows += [(5, 0, "user", None), (5, 1, None, "only"), (None, 0, "user", "no conversation"), (None, None, None, None), (-3, 0, "u", "negative"), (-3, 1, "u", "y")]
    rows += [(10, t, "user", "same") for t in range(300)] + [(11, t, "user", "same") for t in range(280)]  # half of all rows in one id
    rows += [(c, 0, "user", "hello") for c in range(100, 160)]
    _both(spark, rows)


def test_short_conversations_are_turnless(spark):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9)]  # no first of a group
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(_frame(spark, rows)))).collect()
    assert sorted(map(tuple, got)) == _nodes(_rebuilt(_ordered(rows)))
    root = next(r for r in got if r["depth"] == 0)
    assert root["parent_conv_id"] is None and root["n_convs"] == 8 and root["ends_sha256"] != EMPTY


def test_end_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    _both(spark, [(c, t, "user", f"t{t}") for c in range(0, 300, 5) for t in range(3)])


def test_empty_table(spark):
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(_frame(spark, [])))).count() == 0


def test_query_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefix_trie.op13_prefix_trie(spark, "/root/testdata/sf0.001").collect())) == _nodes(_rebuilt(_ordered(rows)))


def test_running_sums_over_tasks_and_wrapping(spark):
    rng = random.Random(4)
    rows = [(1 if i % 3 else rng.randrange(5), i, rng.randrange(-(1 << 63), 1 << 63)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    got = {(r["k"], r["i"]): (r["sum_v"], r["before_v"]) for r in running_sums(df, "k", [F.col("i")], ["v"], "test_running").collect()}
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    sums = {}
    for k, i, v in sorted(rows):
        before = sums.get(k, 0)
        sums[k] = wrap(before + v)
        assert got[k, i] == (sums[k], before)
    pairs = spark.createDataFrame([(a, b) for a in (0, -1, 1, 1 << 62, -(1 << 63), (1 << 63) - 1, 1 << 32) for b in (0, -1, 1, 1 << 62, -(1 << 63), (1 << 63) - 1)], "a long, b long")
    assert all(r["s"] == wrap(r["a"] + r["b"]) for r in pairs.withColumn("s", wrapping_add(F.col("a"), F.col("b"))).collect())
