"""Streaming scorers: texts or CSV files arriving in a folder -> prediction records.

Scoring is row-wise, so the stream is stateless: no watermark, no state store. Each micro-batch
is scored as a batch DataFrame inside ``foreachBatch`` (the scorer's per-row regroup would
otherwise become a stateful streaming aggregation) and written to ``<sink>/batch=<epoch id>`` with
overwrite, so a replayed epoch after a failure rewrites the same output: exactly-once files.
Checkpoints go to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.score import score_table
from ..session import freed_shuffles, spread
from ..schemas import SCORING_INPUT

# files per micro-batch: a backlog (``availableNow``) is worked off in bounded, separately committed
# batches, so a failure replays one batch, not the whole backlog
MAX_FILES_PER_TRIGGER = 1_000


def spread_batch(batch: DataFrame) -> DataFrame:
    """A micro-batch with its rows dealt evenly, unless no partition holds twice its share already.

    The number of partitions does not tell: a file of one row group is cut into many splits, and one of them gets all rows.
    """
    target = batch.sparkSession.sparkContext.defaultParallelism
    sizes = [r[1] for r in batch.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect()]  # one number a partition
    return batch if max(sizes, default=0) * target <= 2 * sum(sizes) else batch.repartition(target)


def _writer(scorer, sink: str, fmt: str, extractor, prepare: Callable[[DataFrame], DataFrame] | None,
            keep_file_order: bool = False, on_batch: Callable[[int], None] | None = None):
    def run(batch: DataFrame, epoch: int) -> None:
        # a micro-batch of a few large files arrives in a few partitions and scoring is CPU-bound,
        # so rows are spread first – after ``prepare`` when it needs the files' own row order
        if keep_file_order:
            rows = spread(prepare(batch) if prepare else batch)
        else:
            rows = spread_batch(batch)
            rows = prepare(rows) if prepare else rows
        preds = score_table(rows, scorer, extractor=extractor)
        with freed_shuffles(batch.sparkSession):
            preds.write.mode("overwrite").format(fmt).save(f"{sink}/batch={epoch}")
        if on_batch:
            on_batch(epoch)

    return run


def stream_score(spark: SparkSession, source: str, scorer, sink: str, checkpoint: str, schema=SCORING_INPUT,
                 source_format: str = "parquet", sink_format: str = "parquet", available_now: bool = True,
                 extractor: Callable[[Column], Column] | None = None,
                 prepare: Callable[[DataFrame], DataFrame] | None = None,
                 max_files: int | None = MAX_FILES_PER_TRIGGER, path_glob: str | None = None,
                 on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Score rows ``(abstract_id, text)`` of files arriving under ``source`` (a folder, or one file).

    ``on_batch(epoch)`` is called when a micro-batch has been written and before it is committed. If it raises, or the
    query dies there, a restart from the same checkpoint writes that batch's files again, so no row is lost or doubled.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.getFileStatus(path).isFile():  # a stream's source is a folder: the file's own, read for its name
        source, path_glob = path.getParent().toString(), path.getName()
    r = spark.readStream.schema(schema).format(source_format)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    stream = r.load(source)
    w = stream.writeStream.foreachBatch(_writer(scorer, sink, sink_format, extractor, prepare, on_batch=on_batch)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_score_csv(spark: SparkSession, source: str, scorer, sink: str, checkpoint: str,
                     columns: list[str] | None = None, available_now: bool = True,
                     extractor: Callable[[Column], Column] | None = None,
                     max_files: int | None = MAX_FILES_PER_TRIGGER) -> StreamingQuery:
    """Score CSV files (``text``, optional ``abstract_id``) arriving under ``source`` -> JSON lines.

    ``columns`` is the CSV header layout (all read as strings); when not given it is taken from the
    files already in ``source``. Rows without an ``abstract_id`` column get ``<file name>#id_<row in the file>``.
    """
    from pyspark.sql import types as T

    if columns is None:
        try:
            columns = spark.read.option("header", "true").csv(source).columns
        except Exception:  # noqa: BLE001 - empty folder: assume the full layout
            columns = ["abstract_id", "text"]
    if "text" not in columns:
        raise ValueError("scoring CSV needs a 'text' column")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = spark.readStream.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    stream = r.csv(source).select("*", F.col("_metadata.file_path").alias("_cf_path"))
    has_id = "abstract_id" in columns

    def prepare(batch: DataFrame) -> DataFrame:
        if has_id:
            return batch.select("abstract_id", "text")
        from ..sources.corpus import file_ordinal

        x = file_ordinal(batch, "_cf_ordinal", path_col="_cf_path")  # files arrive whole, one task each
        # the file's name makes the id unique over files and batches, and leads back to the row
        name = F.regexp_extract("_cf_path", r"([^/]+)$", 1)
        return x.select(F.concat(name, F.lit("#id_"), F.col("_cf_ordinal").cast("string")).alias("abstract_id"), "text")

    w = stream.writeStream.foreachBatch(_writer(scorer, sink, "json", extractor, prepare, keep_file_order=True)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
