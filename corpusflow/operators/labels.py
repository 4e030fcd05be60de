"""Label dimension: sorted distinct labels -> ids, and the lookups in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this many distinct labels the dimension is joined by shuffle instead of broadcast.
MAX_BROADCAST_LABELS = 100_000
MAX_BROADCAST_BYTES = 16 << 20


def label_dimension(df: DataFrame, label_col: str = "label", id_col: str = "label_id") -> DataFrame:
    """``(label, label_id)`` with ids in code-point order of the labels, starting at 0.

    Distinct is a partial aggregation; the rank runs over the distinct labels only.
    """
    d = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias(id_col))


def _small(dim: DataFrame, limit: int) -> bool:
    """Whether the dimension may be broadcast: its rows and the bytes of its names are both checked."""
    names = [f.name for f in dim.schema.fields if f.dataType.simpleString() == "string"]
    size = dim.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.octet_length(c) for c in names), F.lit(16))), F.lit(0))).first()
    return size[0] <= limit and size[1] <= MAX_BROADCAST_BYTES


def with_label_id(df: DataFrame, label_col: str = "label", dim: DataFrame | None = None,
                  id_col: str = "label_id", max_broadcast: int = MAX_BROADCAST_LABELS) -> DataFrame:
    """Add the label id by an equi-join on the label dimension (broadcast when its size is checked)."""
    dim = label_dimension(df, label_col, id_col) if dim is None else dim
    dim = dim.select(F.col("label").alias(label_col), F.col(id_col))
    side = F.broadcast(dim) if _small(dim, max_broadcast) else dim
    return df.join(side, label_col, "left")


def with_label_name(df: DataFrame, id_expr: Column | str, dim: DataFrame, name_col: str = "label",
                    id_col: str = "label_id", max_broadcast: int = MAX_BROADCAST_LABELS) -> DataFrame:
    """Decode a predicted id back to its label name (join on the dimension)."""
    ide = F.col(id_expr) if isinstance(id_expr, str) else id_expr
    tmp = "_cf_pred_id"
    d = dim.select(F.col(id_col).alias(tmp), F.col("label").alias(name_col))
    side = F.broadcast(d) if _small(d, max_broadcast) else d
    return df.withColumn(tmp, ide.cast("int")).join(side, tmp, "left").drop(tmp)


def label_list(dim: DataFrame, max_labels: int = MAX_BROADCAST_LABELS) -> list[str]:
    """Labels ordered by id, for use as literals (class names of a model). Size-checked."""
    rows = dim.orderBy("label_id").limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"more than {max_labels} labels; a classifier needs a bounded label set")
    return [r["label"] for r in rows]


def label_map_row(dim: DataFrame) -> DataFrame:
    """One row ``label2id map<string,int>, id2label map<string,string>`` (ids as strings)."""
    e = F.collect_list(F.struct(F.col("label"), F.col("label_id")))
    return dim.agg(
        F.map_from_entries(F.array_sort(e)).alias("label2id"),
        F.map_from_entries(
            F.transform(F.array_sort(e), lambda s: F.struct(s["label_id"].cast("string"), s["label"]))
        ).alias("id2label"),
    )


def with_default_ids(df: DataFrame, id_col: str = "abstract_id", source: str = "parquet") -> DataFrame:
    """Fill a missing id column with ``id_<row>``: rows counted over the input files in path order.

    ``source="parquet"`` uses the scan's ``_metadata.row_index`` within a file (exact, no shuffle, any
    split of the file); other file sources use the ordinal of ``sources.corpus.file_ordinal``. Rows of
    earlier files are a running sum over one row per file, joined back on the path (a broadcast, see ``per_file_side``).
    """
    if id_col in df.columns:
        return df
    from ..sources.corpus import file_ordinal, file_starts, per_file_side

    if source == "parquet":
        x = df.select("*", F.col("_metadata.row_index").alias("_cf_ordinal"), F.col("_metadata.file_path").alias("_cf_file"))
        x = x.join(per_file_side(file_starts(x, "_cf_file")), "_cf_file")
        number = F.col("_cf_start") + F.col("_cf_ordinal")
    else:
        x = file_ordinal(df.withColumn("_cf_file", F.col("_metadata.file_path")), path_col="_cf_file", over_files=True)
        number = F.col("_cf_ordinal")
    return x.withColumn(id_col, F.concat(F.lit("id_"), number.cast("string"))).drop("_cf_ordinal", "_cf_file", "_cf_start")
