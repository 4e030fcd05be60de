"""Writers: prepared rows, splits, label map, statistics, predictions, metrics, models."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import label_map_row
from .corpus import CSV_OPTIONS


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet", by_split: bool = True, mode: str = "overwrite",
                   order_by: str | None = None) -> None:
    """Prepared rows; ``partitionBy('split')`` so a reader of one split prunes the others.

    CSV is written in the fixed column order of ``schemas.PREPARED`` (its reader is positional).
    ``order_by`` (e.g. ``"filepath"``, the order files were listed in) sorts the export: a range
    exchange on sampled bounds then per-partition sorts, so files come out in global order.
    """
    from ..schemas import PREPARED

    if order_by:
        # the split first: the writer of partitions then needs no sort of its own, which would undo the order
        df = df.orderBy("split", order_by) if by_split and "split" in df.columns else df.orderBy(order_by)

    if fmt == "csv" and set(PREPARED.fieldNames()) <= set(df.columns):
        keep = [c for c in PREPARED.fieldNames() if not (by_split and c == "split")] + (["split"] if by_split else [])
        df = df.select(*keep)
    w = df.write.mode(mode)
    if by_split and "split" in df.columns:
        w = w.partitionBy("split")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.options(**{k: v for k, v in CSV_OPTIONS.items() if k in ("header", "escape", "quote")}).option(
            "quoteAll", "false").csv(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


def _local(path: str) -> str:
    """A ``file:`` URI as a plain path (what the Arrow file systems take); other URIs unchanged."""
    return re.sub(r"^file:/+", "/", path)


def _file_name(x: str | None, what: str) -> str:
    if not x or x in (".", "..") or "/" in x or "\0" in x:
        raise ValueError(f"{x!r} cannot be the name of a {what}")
    return x


def write_class_folders(df: DataFrame, root: str, id_col: str = "abstract_id", text_col: str = "text",
                        label_col: str = "label") -> int:
    """``<root>/<label>/<id>.txt``, one file per row; returns the number of files.

    Spark's writers choose their own file names, so the tasks write the files themselves, through the
    Arrow file system of the root's URI (shared folder or object store). A repeated task writes the same
    files again. An empty text becomes a line break, since scans skip files without a byte. Ids must be distinct within a label, and ids and labels fit for file names (else an error).
    """
    base = _local(root.rstrip("/"))

    def run(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(base)
        made: set[str] = set()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label")), strict=True)
            for name, text, label in rows:
                folder = f"{top}/{_file_name(label, 'class folder')}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/{_file_name(name, 'file')}.txt") as out:
                    out.write((text or "\n").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def delete_files(paths: DataFrame, path_col: str, base: str) -> int:
    """Delete the files named by the rows, by the tasks that hold them; returns how many were there. Each must lie under ``base``."""
    top = _local(base.rstrip("/"))

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(top)
        for batch in batches:
            n = 0
            for x in batch.column("path").to_pylist():
                rest = _local(x).removeprefix(f"{top}/")
                if rest == _local(x) or ".." in rest.split("/"):
                    raise ValueError(f"{x} is not under {base}")
                try:
                    system.delete_file(f"{root}/{rest}")
                    n += 1
                except FileNotFoundError:  # a repeated task
                    pass
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return paths.select(F.col(path_col).alias("path")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_label_map(dim: DataFrame, path: str) -> None:
    """``{"label2id": {...}, "id2label": {...}}`` as one JSON record."""
    label_map_row(dim).coalesce(1).write.mode("overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(preds: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prediction records as JSON lines, one file per partition (no single-writer bottleneck)."""
    preds.write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, path: str, by: str | None = "model") -> None:
    """Metric records. A frame with a ``json`` column (from ``operators.compare.metrics_json``) is
    written as the records themselves, one per line; other frames as JSON rows."""
    if "json" in metrics.columns:
        keep = [by] if by and by in metrics.columns else []
        w = metrics.select(*keep, "json").write.mode("overwrite")
        (w.partitionBy(by) if keep else w).text(path)
        return
    w = metrics.write.mode("overwrite")
    if by and by in metrics.columns:
        w = w.partitionBy(by)
    w.json(path)


def save_model(model, path: str) -> None:
    """Naive Bayes models write their parameter table; Spark ML models their own layout."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


def to_display(preds: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` predictions in id order (a preview; top-n, not a collect of everything).

    Shorter ids come first, so ``id_2`` stands before ``id_10``.
    """
    return preds.orderBy(F.length("abstract_id"), F.col("abstract_id")).limit(n)
