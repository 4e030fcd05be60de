"""Left join of many rows with a large dimension whose keys are unevenly used (words with a vocabulary).

A few keys hold most of the rows. They are found by a count sketch, and their dimension rows are broadcast, so the
bulk of the rows never moves; only the rest is shuffled to the dimension. How many keys count as
hot is bounded by the share they must hold, not by the data: at most ``1 / share``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# share of all rows from which a key is hot, and cells of the sketch
SHARE, CELLS = 1e-4, 1 << 16


def hot_keys(rows: DataFrame, key: str, share: float = SHARE, cells: int = CELLS) -> DataFrame:
    """``key`` of every key that more than ``share`` of the rows hold (exact; at most ``1 / share`` rows).

    Rows are counted by hash cell first (at most ``cells`` numbers a task cross the shuffle). Only keys of cells
    above the threshold can be above it, and only those are counted by key.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(cells)).alias("_cell")
    known = rows.where(F.col(key).isNotNull())
    sketch = materialize(known.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")), "hot_cells")
    total = sketch.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    heavy = sketch.where(F.col("_n") > total * share).select("_cell")  # at most 1 / share rows
    often = known.select(key, cell).join(F.broadcast(heavy), "_cell").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(often.where(F.col("_n") > total * share).select(key), "hot_keys")


def hot_cold_join(rows: DataFrame, dim: DataFrame, key: str, share: float = SHARE, cells: int = CELLS) -> DataFrame:
    """``rows`` left-joined to ``dim`` on ``key``; ``dim`` has one row a key and ``rows`` is cheap to read again (a written table).

    Hot keys (found or not in ``dim``) join a broadcast of at most ``1 / share`` rows; the others join by shuffle;
    rows without a key join nothing.
    """
    hot = hot_keys(rows, key, share, cells)
    values = [c for c in dim.columns if c != key]
    hot_dim = materialize(dim.join(F.broadcast(hot), key, "right"), "hot_rows").select(key, *values)
    warm = rows.join(F.broadcast(hot_dim), key)
    cold = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(dim, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in values])
    columns = [*rows.columns, *values]
    return warm.select(*columns).unionByName(cold.select(*columns)).unionByName(none.select(*columns))
