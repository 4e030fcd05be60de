"""Connected components of a link table, as Spark joins and aggregates.

Small-star and large-star steps alternate until the links no longer change: a node's smaller
neighbours are tied to the smallest of them, then every node to the smallest around it. Links are
thinned within each partition to a spanning forest, which leaves most components in one or two steps.
Minima are partial aggregates, and the joins are plain equi-joins that adaptive execution splits at a
hub, so a component with a third of all nodes needs no task of its own. Nothing is collected but one
checksum a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize

MAX_STEPS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node with the smallest node of its part (union by least label, by array steps)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_a, kept_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        kept_a, kept_b = forest(np.concatenate([kept_a, a]), np.concatenate([kept_b, b]))
        if len(kept_a) > 1_000_000:  # bounded memory: hand on what is thinned so far
            yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], ["a", "b"])
            kept_a, kept_b = kept_a[:0], kept_b[:0]
    yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long) -> node, component (the smallest node it is linked with) for all linked nodes.

    Null ends and self links are ignored; an empty table gives an empty result.
    """
    ends = F.col("a").cast("long"), F.col("b").cast("long")
    e = links.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).where("a <> b").distinct()
    e = materialize(e.mapInArrow(_thin, "a long, b long"), "links")
    check = None
    for _ in range(MAX_STEPS):
        # small star: a node and its smaller neighbours go to the smallest of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.withColumnRenamed("m", "b")).distinct()
        small = materialize(small.mapInArrow(_thin, "a long, b long"), "links")
        # large star: the larger neighbours of a node go to the smallest node around it
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(large.where("a <> b").distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == check:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        check = now
    raise RuntimeError(f"links still change after {MAX_STEPS} steps")
