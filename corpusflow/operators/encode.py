"""Token ids: corpus vocabulary, fixed-length id sequences and attention masks.

The vocabulary holds all tokens by falling count (ties by token), or the ``size`` most frequent, with ids
after the reserved ids (0 = padding, 1 = unknown). Counting is an explode + partial aggregation; a
``size`` cut is a ``TakeOrderedAndProject`` (per-partition top-k, then a merge of at most ``size``
rows per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import attention_mask, pad_truncate
from ..session import materialize
from .hotjoin import hot_cold_join

PAD_ID, UNK_ID = 0, 1
RESERVED = 2


def build_vocab(df: DataFrame, tokens_col: str = "tokens", size: int | None = None, min_count: int = 1) -> DataFrame:
    """``token, token_id, n`` of all tokens, or of the ``size`` most frequent ones.

    Ids of a cut vocabulary come from a window over its at most ``size`` rows. A whole one is as large
    as the corpus makes it: its ids are positions in a distributed sort (start of the row's partition
    plus row in it), so no task numbers it alone.
    """
    counts = df.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_count)
    if size is None:
        m = F.monotonically_increasing_id()
        rows = materialize(counts.orderBy(F.desc("n"), F.asc("token")).select("token", "n", m.alias("_m")), "vocabulary")
        rows = rows.withColumn("_part", F.shiftright("_m", 33))
        w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
        starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select("_part", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_s"))
        place = F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + RESERVED
        return rows.join(starts, "_part").select("token", place.cast("int").alias("token_id"), "n")
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select("token", (F.row_number().over(w) + RESERVED - 1).cast("int").alias("token_id"), "n")


def encode(df: DataFrame, tokens_col: str, vocab: DataFrame, max_len: int = 256, ids_col: str = "input_ids",
           mask_col: str = "attention_mask") -> DataFrame:
    """Add ``input_ids`` (cut/padded to ``max_len``, unknown -> 1) and ``attention_mask``.

    The first ``max_len`` tokens of each row are written once with a row id. Their positions are joined to the
    vocabulary as hot and cold words (``hotjoin``): words that hold a share of all positions meet a broadcast of
    bounded size, the rest of a vocabulary of any size is joined by shuffle. The regroup per row starts with
    map-side partial aggregation, so one row per document and branch (its other columns and at most
    ``max_len`` ids) is shuffled. The token column is replaced by the ids. A row without tokens (null or empty)
    is all padding.
    """
    # the row's other columns are fixed per id and join the grouping key, so the regroup needs no join back to the
    # input and the full token array never crosses a shuffle
    key = "_cf_row"
    carry = [c for c in df.columns if c != tokens_col]
    keyed = df.select(F.monotonically_increasing_id().alias(key), *carry, F.slice(F.col(tokens_col), 1, max_len).alias("_cf_cut"))
    keyed = materialize(keyed, "encode_rows")  # both branches of the join must see the same ids
    ex = keyed.select(key, *carry, F.posexplode_outer("_cf_cut").alias("_p", "token"))
    j = hot_cold_join(ex, vocab.select("token", "token_id"), "token")
    item = F.when(F.col("_p").isNotNull(), F.struct(F.col("_p"), F.coalesce("token_id", F.lit(UNK_ID)).alias("i")))
    per = j.groupBy(key, *carry).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    out = per.select(*carry, F.transform("_s", lambda s: s["i"]).alias(ids_col))
    return out.withColumn(mask_col, attention_mask(F.col(ids_col), max_len)).withColumn(
        ids_col, pad_truncate(F.col(ids_col), max_len, PAD_ID))
