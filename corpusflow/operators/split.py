"""Exact, seeded train/validation/test split and the seeded order behind it.

Order: every row gets the key ``md5('<seed>:<id>')``; rows are ordered by ``(key, id)``. The first
``floor(n * train_ratio)`` rows are ``train``, the next ``floor(n * val_ratio)`` are ``val``, the rest
``test`` – exact sizes, the same under any partitioning or input order.

Scale design (no shuffle of the documents):

1. ``n`` and a histogram of rows per hash bucket (the first hex digits of the key) come from one
   narrow scan of the id column with map-side partial aggregation (at most ``16**digits`` groups).
2. For each of the two cut positions, the bucket holding it is found in that bounded histogram, and
   the exact cut key ``(key*, id*)`` is found among the distinct keys of that one bucket.
3. The split of every row is then a comparison of ``(key, id)`` with the two cut keys – a projection
   inside whole-stage codegen, no exchange.

Rows sharing the cut key (a duplicated id straddling a cut) are the one case that needs a per-row
order; they are cut off, written to the shared checkpoint folder, and split exactly by a per-scan-
partition quota (no single-task window).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = "_cf_key"
B = "_cf_bucket"


def _check_ratios(train_ratio: float, val_ratio: float) -> None:
    if not (0 < train_ratio < 1 and 0 < val_ratio < 1 and train_ratio + val_ratio < 1):
        raise ValueError("ratios must each lie in (0, 1) and sum to less than 1")


def seeded_key(id_col: Column | str, seed: int = 42) -> Column:
    """Repeatable pseudo-random order key: md5 of ``'<seed>:<id>'`` (lower-case hex)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def _bucket(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def split_sizes(n: int, train_ratio: float, val_ratio: float) -> tuple[int, int, int]:
    """``int(n * ratio)`` over doubles for train and val, the remainder for test."""
    _check_ratios(train_ratio, val_ratio)
    n_train = int(math.floor(n * float(train_ratio)))
    n_val = int(math.floor(n * float(val_ratio)))
    return n_train, n_val, n - n_train - n_val


def _locate_cuts(ids: DataFrame, id_col: str, train_ratio: float, val_ratio: float):
    """Find the keys at the two cut positions of the seeded order.

    Job 1: rows per bucket (partial aggregation; at most ``16**digits`` groups), cumulative starts
    by a window over that bounded histogram; only the at most two buckets holding a cut come back
    to the driver. Job 2: the distinct keys of those buckets with their multiplicities (a hot
    duplicated id collapses to one row), ranked inside each bucket; only the cut keys come back.

    Returns ``(n, [cut1, cut2])``; a cut is ``(key, id, copies, copies_before_cut)`` or ``None``
    when the cut position is past the end.
    """
    hist = ids.groupBy(B).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(
        B, "_c",
        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_s"),
        F.sum("_c").over(Window.partitionBy()).alias("_n"),
    )
    p1 = F.floor(F.col("_n") * F.lit(float(train_ratio)))
    p2 = p1 + F.floor(F.col("_n") * F.lit(float(val_ratio)))

    def holds(p: Column) -> Column:
        return (F.col("_s") <= p) & (F.col("_s") + F.col("_c") > p)

    found = hist.where(holds(p1) | holds(p2)).collect()
    if not found:
        n = ids.count() if ids.limit(1).count() else 0
        return n, [None, None]
    n = int(found[0]["_n"])
    n_train, n_val, _ = split_sizes(n, train_ratio, val_ratio)
    positions = (n_train, n_train + n_val)
    starts = {int(r[B]): int(r["_s"]) for r in found}
    smap = F.create_map(*[x for b, s in starts.items() for x in (F.lit(b), F.lit(s))])
    keys = (
        ids.where(F.col(B).isin(list(starts)))
        .groupBy(B, K, id_col)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    wk = Window.partitionBy(B).orderBy(K, id_col).rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("_s", F.coalesce(F.sum("_c").over(wk), F.lit(0)) + F.element_at(smap, F.col(B)))
    cond = F.lit(False)
    for p in positions:
        cond = cond | ((F.col("_s") <= p) & (F.col("_s") + F.col("_c") > p))
    rows = keys.where(cond).collect()
    cuts = []
    for p in positions:
        hit = [r for r in rows if r["_s"] <= p < r["_s"] + r["_c"]]
        cuts.append((hit[0][K], hit[0][id_col], int(hit[0]["_c"]), p - int(hit[0]["_s"])) if hit else None)
    return n, cuts


def _before(key: Column, idc: Column, cut) -> Column:
    """(key, id) strictly before the cut key; a null id comes before the other ids of its key."""
    k, i = F.lit(cut[0]), F.lit(cut[1])
    earlier = F.lit(False) if cut[1] is None else (idc.isNull() | (idc < i))
    return (key < k) | ((key == k) & earlier)


def split_exact(
    df: DataFrame,
    id_col: str,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    seed: int = 42,
    split_col: str = "split",
    bucket_digits: int = 5,
) -> DataFrame:
    """Add ``split_col`` in ``train | val | test`` with exact sizes (see module doc).

    Runs two small jobs over the id column only (bucket histogram, keys of at most two
    buckets), each returning at most two rows to the driver; the returned DataFrame itself is a narrow projection of ``df``.
    """
    _check_ratios(train_ratio, val_ratio)
    keyed = df.withColumn(K, seeded_key(id_col, seed)).withColumn(B, _bucket(F.col(K), bucket_digits))
    ids = keyed.select(K, B, id_col)
    _, cuts = _locate_cuts(ids, id_col, train_ratio, val_ratio)

    key, idc = F.col(K), F.col(id_col)
    names = ["train", "val", "test"]

    def label_for(before_first: Column, before_second: Column) -> Column:
        return F.when(before_first, F.lit(names[0])).when(before_second, F.lit(names[1])).otherwise(F.lit(names[2]))

    c1 = _before(key, idc, cuts[0]) if cuts[0] else F.lit(True)
    c2 = _before(key, idc, cuts[1]) if cuts[1] else F.lit(True)
    out = keyed.withColumn(split_col, label_for(c1, c2))

    # copies of a cut key that straddle the cut (duplicated ids only)
    straddles = [(i, c) for i, c in enumerate(cuts) if c is not None and c[2] > 1 and c[3] > 0]
    if straddles:
        out = _split_straddling(out, keyed, id_col, split_col, cuts, straddles, names)
    return out.drop(K, B)


def _split_straddling(out, keyed, id_col, split_col, cuts, straddles, names):
    """Exact split of the copies of a duplicated key that sits on a cut.

    The copies of each such key are written to the shared checkpoint folder (a reliable
    checkpoint), so their scan order is fixed and survives executor loss. A copy's rank is then
    ``copies in earlier scan partitions + row index in its partition``; the prefix comes from one
    count per partition. No window, no single task holding the group.
    """
    from pyspark.sql import SparkSession

    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(SparkSession.getActiveSession())
    key, idc = F.col(K), F.col(id_col)
    by_key: dict = {}
    for i, c in straddles:
        by_key.setdefault((c[0], c[1]), []).append((i, c[3]))
    hot = F.lit(False)
    for k, i in by_key:
        hot = hot | ((key == F.lit(k)) & idc.eqNullSafe(F.lit(i)))
    result = out.where(~hot)
    for (k, i), marks in by_key.items():
        copies = keyed.where((key == F.lit(k)) & idc.eqNullSafe(F.lit(i))).checkpoint(eager=True)
        copies = copies.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
        # copies in earlier partitions: a running sum over one row per partition, joined back
        earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        prefix = copies.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        prefix = prefix.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        copies = copies.join(prefix, "_p")
        rank = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        # cut i at offset m: copies ranked below m belong to split i, the others to a later split
        label = F.lit(names[max(j for j, _ in marks) + 1])
        for j, m in sorted(marks, reverse=True):
            label = F.when(rank < F.lit(m), F.lit(names[j])).otherwise(label)
        result = result.unionByName(copies.withColumn(split_col, label).drop("_m", "_p", "_before"))
    return result


def seeded_rank(df: DataFrame, id_col: str, seed: int = 42, pos_col: str = "pos") -> DataFrame:
    """0-based position of every row in the seeded order (a distributed, skew-free rank).

    One range exchange sorts the rows by ``(key, id)``; copies of an id are ordered by a hash of their
    place in the input, so a hot id is spread over range partitions like any other rows. The sorted rows
    are written to the shared checkpoint folder with their place in their partition (which fixes the
    order if a task is run again), and a row's position is that place plus the rows of the partitions
    before – a running sum over one row per partition. A null id comes before the other ids of its key.

    Use ``split_exact`` when only the split is needed: it does not move the rows at all.
    """
    from ..session import materialize

    tie = F.xxhash64(F.monotonically_increasing_id())
    ordered = df.withColumn(K, seeded_key(id_col, seed)).withColumn("_t", tie).orderBy(K, id_col, "_t").drop(K, "_t")
    rows = materialize(ordered.withColumn("_m", F.monotonically_increasing_id()), "seeded_rank")
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"))
    place = F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "_p").withColumn(pos_col, place.cast("long")).drop("_p", "_m", "_s")
