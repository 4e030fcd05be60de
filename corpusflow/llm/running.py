"""Running sums along an order within keys, without bringing a key together in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize


def running_sums(df: DataFrame, key: str, order: list[Column], values: list[str], name: str) -> DataFrame:
    """Adds ``sum_<v>`` and ``before_<v>``: sums of each value over a key's rows up to and before this one.

    ``key`` and the values are longs; sums wrap at 64 bits. The rows are range-partitioned by key and order, so
    a key with a large share of all rows lies in several tasks. Each task sums its own rows; a key
    that began in an earlier task gets that task's total added, which is one row a task (a table of at most
    as many rows as partitions, and so small enough to broadcast). The result is written to the shared folder.
    """
    rest = [c for c in df.columns if c != key and c not in values]
    fields = [df.schema[c] for c in [key, *values, *rest]]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        last, carry = None, np.zeros((len(values), 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(key).to_numpy(zero_copy_only=False)
            v = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in values], np.int64)
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(head, n))
            total = np.cumsum(v, axis=1)
            base = total[:, head] - v[:, head]
            if last == k[0]:
                base[:, :1] -= carry
            sums = total - np.repeat(base, size, axis=1)
            last, carry = int(k[-1]), sums[:, -1:].copy()
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(x) for x in sums] + [pa.array(x) for x in sums - v]
            columns += [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(seen, seen + n))]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [*(f.name for f in fields), *(f"sum_{v}" for v in values), *(f"before_{v}" for v in values), "task", "place"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{s}_{v}` long" for s in ("sum", "before") for v in values])
    dealt = df.select(key, *values, *rest).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = materialize(dealt.mapInArrow(local, f"{schema}, task int, place long"), name)
    tails = rows.groupBy("task").agg(F.max_by(F.struct(key, *[f"sum_{v}" for v in values]), "place").alias("x")).select("task", "x.*").collect()
    offsets, open_key, carried = [], None, [0] * len(values)
    first = {r["task"]: r[key] for r in rows.groupBy("task").agg(F.min(key).alias(key)).collect()}
    for r in sorted(tails, key=lambda r: r["task"]):
        if first[r["task"]] == open_key:
            offsets.append((r["task"], open_key, *carried))
        if r[key] != open_key:
            open_key, carried = r[key], [0] * len(values)
        carried = [_wrapped(a + r[f"sum_{v}"]) for a, v in zip(carried, values, strict=True)]
    if not offsets:
        return rows.drop("task", "place")
    more = df.sparkSession.createDataFrame(offsets, f"off_task int, off_key long, {', '.join(f'off_{v} long' for v in values)}")
    j = rows.join(F.broadcast(more), (F.col("task") == F.col("off_task")) & (F.col(key) == F.col("off_key")), "left")
    # plus with wrapping: in two halves, since an overflow is an error otherwise
    out = [wrapping_add(F.col(f"{s}_{v}"), F.coalesce(f"off_{v}", F.lit(0))).alias(f"{s}_{v}") for s in ("sum", "before") for v in values]
    return j.select(*[f.name for f in fields], *out)


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, as a signed long."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))
