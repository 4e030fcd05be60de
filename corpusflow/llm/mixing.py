"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow network
routes each pattern's words to the quotas of its sources; the first copy of a pattern costs nothing
and every further copy costs more (convex), so texts repeat only where a quota needs it. Documents
are then chosen by a seeded order of ids: whole copies for all, and the last, partial copy for the
documents before the pattern's cut.

The network holds one node per pattern and one per source. Everything per document is a join-free
projection against its pattern's cut; the cut itself comes from a histogram of seeded hash buckets
(pre-aggregated before its shuffle), and only the documents of the one bucket that holds the cut are
put in order, so a source with a third of all rows is never sorted in one task.

Defined cases: a null or blank text has size 0, takes 0 and is kept in the result; a null source is a
source of its own, last in order; repeated rows each give a row; no documents give no rows; a source
without words gets target 0; columns beside ``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize, read, with_columns, word_count

SEED = 17
#: Fixed by the contract: weights by source in order, repeating; share of all words; copies at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2
#: Patterns that the network may hold; beyond it the call raises (the operator never drops a pattern).
MAX_PATTERNS = 200_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """Targets per source: ``share`` of all words dealt by weight, none above ``copies`` times its size.

    Dealing the excess again until none is above ends where every open source gets ``weight * level``:
    with sources in order of ``cap / weight``, those whose cap is below the level that would remain
    for them are full, and one running sum gives the level of the others.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight")).withColumn("cap", copies * F.col("source_size").cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("words", share * F.sum(F.col("source_size").cast("double")).over(everything))
    s = s.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def min_cost_flow(patterns: list[tuple[frozenset, int]], quotas: dict, copies: int = COPIES) -> list[dict]:
    """Words of each pattern routed to each of its sources.

    Copy ``k`` of a pattern offers its size at cost ``k``. As costs rise with ``k`` and sit on the
    patterns' own arcs, augmenting copy by copy along shortest residual paths gives a flow of least
    cost among those that fill the quotas as far as they can be.
    """
    flow: list[dict] = [dict.fromkeys(members, 0) for members, _ in patterns]
    into: dict = {s: [] for s in quotas}
    for p, (members, _) in enumerate(patterns):
        for s in members:
            into[s].append(p)
    need = dict(quotas)
    for _ in range(copies):
        for start, (members, size) in enumerate(patterns):
            left = size
            while left > 0:
                # shortest path from this pattern to a source with need; back arcs reroute flow
                came, queue, goal = {("p", start): None}, deque([("p", start)]), None
                while queue and goal is None:
                    kind, node = at = queue.popleft()
                    if kind == "p":
                        nexts = [("s", s) for s in patterns[node][0]]
                    elif need[node] > 0:
                        goal = at
                        break
                    else:
                        nexts = [("p", p) for p in into[node] if len(patterns[p][0]) > 1 and flow[p][node] > 0]
                    for n in nexts:
                        if n not in came:
                            came[n] = at
                            queue.append(n)
                if goal is None:
                    break
                path, at = [], goal
                while at is not None:
                    path.append(at)
                    at = came[at]
                path.reverse()
                push = min(left, need[goal[1]])
                for a, b in zip(path, path[1:], strict=False):
                    if a[0] == "s":
                        push = min(push, flow[b[1]][a[1]])
                for a, b in zip(path, path[1:], strict=False):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += push
                    else:
                        flow[b[1]][a[1]] -= push
                need[goal[1]] -= push
                left -= push
    return flow


def seeded_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), ).cast("binary"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = SEED, copies: int = COPIES) -> DataFrame:
    """Words taken of each document. docs: doc_id, size, sources (array), more; targets: source, target."""
    spark = docs.sparkSession
    d = docs.withColumn("pattern", F.array_sort("sources")).withColumn("order_key", seeded_key(F.col("doc_id"), seed))
    d = d.withColumn("bucket", F.substring("order_key", 1, 4))
    buckets = materialize(d.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "mix_buckets")
    patterns = [(r["pattern"], int(r["words"])) for r in buckets.groupBy("pattern").agg(F.sum("words").alias("words")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; raise MAX_PATTERNS")
    quotas = {r["source"]: int(r["target"] + 0.5) for r in targets.collect()}
    flow = min_cost_flow([(frozenset(m), n) for m, n in patterns], quotas, copies)
    cuts = [(m, *(divmod(sum(f.values()), n) if n else (0, 0))) for (m, n), f in zip(patterns, flow, strict=True)]
    cut = spark.createDataFrame(cuts, "pattern array<string>, whole long, rest long")

    running = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    at = b.join(cut, "pattern").where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    at = at.select("pattern", "whole", "rest", "before", F.col("bucket").alias("cut_bucket"))

    d = d.join(at, "pattern", "left")  # one row per pattern; patterns without words have none
    whole = F.coalesce(F.col("whole"), F.lit(0))
    base = [c for c in docs.columns]
    sure = d.where(F.coalesce(F.col("bucket") != F.col("cut_bucket"), F.lit(True)))
    sure = sure.select(*base, (F.col("size") * (whole + F.when(F.col("bucket") < F.col("cut_bucket"), 1).otherwise(0))).alias("taken"))
    inner = Window.partitionBy("pattern").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where(F.col("bucket") == F.col("cut_bucket"))
    edge = edge.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edge = edge.select(*base, (F.col("size") * (whole + F.when(2 * F.col("start") + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0))).alias("taken"))
    return sure.unionByName(edge)


def mix_documents(documents: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A mix of a documents table: doc_id, size, source_size, target, taken, source, and the columns to keep."""
    d = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    d = materialize(d, "mix_sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes), "mix_targets")
    taken = mix(d.withColumn("sources", F.array("source")), targets.select("source", "target"), seed)
    t = targets.withColumnRenamed("source", "target_source")
    out = taken.join(t, F.col("source").eqNullSafe(F.col("target_source")))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", *keep)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_columns(read(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string", "source": "string"})
    return mix_documents(d).drop("source")


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap <= weight * level AS filled FROM l),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * (SELECT max(level) FROM f WHERE NOT filled) END AS target FROM f),
o AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target + 0.5) AS BIGINT) // t.source_size END AS whole,
             CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target + 0.5) AS BIGINT) % t.source_size END AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * start + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
