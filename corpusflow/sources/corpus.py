"""Readers: class folders of text files, CSV splits and scoring files, label maps, metrics files.

Every reader gives an explicit schema (no inference): ids stay strings and the text ``NA`` stays text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.compare import core_table
from ..schemas import LABEL_MAP, PREPARED, SCORING_INPUT
from ..session import materialize

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "multiLine": "true", "mode": "PERMISSIVE"}

# bytes that opening a small text file counts for when scan partitions are packed
OPEN_COST = 64 << 10
# one row a file is broadcast up to so many files
MAX_BROADCAST_FILES = 100_000
# bytes of small files that a task reads, about
READ_BYTES = 64 << 20
# bytes of small files that leave a reading task at once
FILES_BATCH_BYTES = 4 << 20


def _decoded_path() -> Column:
    # file paths in _metadata are URI-encoded; keep a literal '+' before decoding
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def _local_path(c: Column) -> Column:
    """A file URI without its scheme and authority."""
    return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _roots(spark: SparkSession, root: str) -> list[str]:
    """URIs (not encoded) that ``root`` stands for: itself, or the folders that a glob matches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uris = [fs.makeQualified(s.getPath()).toUri() for s in fs.globStatus(path) or [] if s.isDirectory()]
    return [f"{u.getScheme()}:{'//' + u.getAuthority() if u.getAuthority() else ''}{u.getPath()}" for u in uris]


def _arrow_fs(uri: str):
    """The Arrow file system of a URI and the path in it; a plain path for ``file:`` (its name may hold any character)."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), _path_of(uri)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _seen_by_scans(name: str) -> bool:
    """Whether Spark's scans read a file or folder of this name (the others count as hidden)."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, bytes of the text files directly inside each folder."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            system, top = _arrow_fs(folder)
            found = [(f"{folder}/{x.base_name}", x.size) for x in system.get_file_info(fs.FileSelector(top))
                     if x.type == fs.FileType.File and x.size and x.base_name.endswith(".txt") and _seen_by_scans(x.base_name)]
            for lo in range(0, len(found), 10_000):
                paths, sizes = zip(*found[lo : lo + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], ["path", "bytes"])


def _file_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, value (the bytes) of each file; files that cannot be read are skipped."""
    paths, values, held = [], [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])

    systems: dict = {}
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            folder, name = uri.rsplit("/", 1)
            if folder not in systems:
                systems[folder] = _arrow_fs(folder)
            system, top = systems[folder]
            try:
                with system.open_input_file(f"{top}/{name}") as f:
                    value = f.read()
            except FileNotFoundError:
                raise
            except OSError:
                continue
            paths.append(uri)
            values.append(value)
            held += len(value)
            if held > FILES_BATCH_BYTES:
                yield done()
                paths, values, held = [], [], 0
    yield done()


def _text_files(spark: SparkSession, roots: list[str], min_partitions: int | None) -> DataFrame | None:
    """path, value of the text files of the class folders, listed and read by tasks (None: only Spark reads this store).

    The driver lists the roots for their class folders, a task lists a folder, and the files are dealt out by name, so that
    neither a list of all files nor one plan entry a file is held by the driver.
    """
    from pyarrow import fs

    folders = []
    try:
        for root in roots:
            system, top = _arrow_fs(root)
            folders += [f"{root}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.Directory and _seen_by_scans(x.base_name)]
    except (OSError, ValueError, NotImplementedError):
        return None
    if not folders:
        return None
    tasks = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))
    files = materialize(tasks.mapInArrow(_listed, "path string, bytes long"), "text_files")
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    least = min_partitions or 4 * spark.sparkContext.defaultParallelism
    dealt = files.select("path").repartition(max(least, total // READ_BYTES + 1))
    return dealt.mapInArrow(_file_bytes, "path string, value binary")


def read_class_folders(spark: SparkSession, root: str, required: list[str] | None = None,
                       min_partitions: int | None = None) -> DataFrame:
    """``<root>/<label>/<id>.txt`` -> ``abstract_id, text, label, filepath``.

    The files are listed and read by tasks (``_text_files``). In a store that only Spark reads it is one
    listing of the root (``recursiveFileLookup`` + ``pathGlobFilter``), and small files are packed into scan
    partitions by Spark. Only files directly inside a
    class folder count. Text is stripped; bytes that are not UTF-8 are dropped (as U+FFFD markers,
    which also removes genuine U+FFFD characters). Unreadable files are skipped.
    """
    roots = _roots(spark, root)
    raw, path = _text_files(spark, roots, min_partitions), F.col("path")
    if raw is None:
        reader = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
                  .option("ignoreCorruptFiles", "true"))
        raw, path = reader.text(root, wholetext=True), _decoded_path()
    parts = F.split(path, "/")
    df = raw.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("abstract_id"),
        strip_ws(F.regexp_replace(F.col("value").cast("string"), "\ufffd", "")).alias("text"),
        F.element_at(parts, -2).alias("label"),
        path.alias("filepath"),
    ).where(_local_path(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/")).isin([_path_of(r) for r in roots]))
    if required:
        require_labels(df, required, root)
    return df


@contextmanager
def packed_scan(spark: SparkSession, open_cost: int = OPEN_COST):
    """Plans made inside count a small file as ``open_cost`` bytes more than it has (the default is 4 MB), so
    that scan partitions fill up with as many files as their bytes allow."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(open_cost))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compact_class_folders(spark: SparkSession, root: str, required: list[str] | None = None,
                          open_cost: int = OPEN_COST) -> DataFrame:
    """``read_class_folders`` written once as Parquet in the shared folder.

    The many small files are listed and opened once, in scan partitions packed by their bytes; cleaning,
    the label list, the split and every later job then scan columns of a few larger files.
    """
    with packed_scan(spark, open_cost):
        df = materialize(read_class_folders(spark, root), "class_folders")
    if required:
        require_labels(df, required, root)
    return df


def require_labels(df: DataFrame, required: list[str], where: str = "") -> None:
    """Raise ``FileNotFoundError`` unless every required class folder produced rows."""
    found = {r[0] for r in df.select("label").distinct().collect()}  # one row per class folder
    missing = [x for x in required if x not in found]
    if missing:
        raise FileNotFoundError(f"expected class folders {missing} under {where}")


def read_prepared_csv(spark: SparkSession, path: str, schema=PREPARED) -> DataFrame:
    """Prepared rows written as CSV (quotes doubled)."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def read_prepared(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Prepared rows written as Parquet partitioned by ``split`` (the filter prunes partitions)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def per_file_side(per_file: DataFrame) -> DataFrame:
    """One row a file, written once, as the side of a join by path: up to ``MAX_BROADCAST_FILES`` it is broadcast, so that
    the rows of the files (with their texts) stay where they are."""
    side = materialize(per_file, "per_file")
    return F.broadcast(side) if side.limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES else side


def file_ordinal(df: DataFrame, col: str = "_cf_ordinal", path_col: str | None = None, over_files: bool = False) -> DataFrame:
    """0-based row number inside each input file, in file order (``over_files``: counted on over the files in path order).

    CSV read with ``multiLine`` is not split, so a file is read by one task in order and
    ``monotonically_increasing_id`` rises along the file. The ordinal is that id minus the smallest
    id of the same file; the per-file minimum is a grouped aggregate (partial aggregation, one row
    per file) joined back on the path (see ``per_file_side``). No window over rows, so
    a file holding a large share of the rows is never gathered and sorted in one task.
    """
    m = "_cf_mono"
    f = path_col or "_cf_file"
    x = df.withColumn(m, F.monotonically_increasing_id())
    if path_col is None:
        x = x.withColumn(f, F.col("_metadata.file_path"))
    first = x.groupBy(f).agg(F.min(m).alias("_cf_first"), F.count(F.lit(1)).alias("_n"))
    if over_files:
        first = first.withColumn("_cf_first", F.col("_cf_first") - _rows_before(f))
    out = x.join(per_file_side(first.drop("_n")), f).withColumn(col, F.col(m) - F.col("_cf_first")).drop(m, "_cf_first")
    return out if path_col else out.drop(f)


def _rows_before(path_col: str) -> Column:
    """Over one row a file with its number of rows ``_n``: the rows in the files before it, in path order."""
    w = Window.orderBy(path_col).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(w), F.lit(0))


def file_starts(df: DataFrame, path_col: str) -> DataFrame:
    """``path, _cf_start``: rows in the files before each file, in path order (one row per file)."""
    per_file = df.groupBy(path_col).agg(F.count(F.lit(1)).alias("_n"))
    return per_file.select(path_col, _rows_before(path_col).alias("_cf_start"))


def export_positions(spark: SparkSession, path: str, split_col: str = "split") -> DataFrame:
    """Rows of a prepared Parquet export with ``pos``, their place within the split over its files in name order.

    A file's rows are numbered by the scan; files before it are a running sum over one row a file.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("_cf_row"), F.col("_metadata.file_path").alias("_cf_file"))
    per_file = rows.groupBy(split_col, "_cf_file").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(split_col).orderBy("_cf_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.select("_cf_file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_cf_start"))
    few = starts.limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES  # then the rows stay where they are
    out = rows.join(F.broadcast(starts) if few else starts, "_cf_file").withColumn("pos", F.col("_cf_start") + F.col("_cf_row"))
    return out.drop("_cf_file", "_cf_row", "_cf_start")


def read_scoring_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scoring input: ``text`` required, ``abstract_id`` optional (else ``id_<row>``, counted over the files in path order)."""
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    if "text" not in header:
        raise ValueError("scoring CSV needs a 'text' column")
    if "abstract_id" in header:
        cols = [F.col("abstract_id").cast("string"), F.col("text").cast("string")]
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path).select(*cols)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    from ..operators.labels import with_default_ids

    return with_default_ids(df, source="csv").select("abstract_id", "text")


def text_source(spark: SparkSession, text: str, abstract_id: str = "manual_input") -> DataFrame:
    """One literal text as a one-row source."""
    return spark.createDataFrame([(abstract_id, text)], SCORING_INPUT)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label-map JSON -> dimension ``label, label_id``."""
    m = spark.read.schema(LABEL_MAP).option("multiLine", "true").json(path)
    return m.select(F.explode("label2id").alias("label", "label_id")).withColumn("label_id", F.col("label_id").cast("int"))


def read_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Metrics JSON files (any producer layout) -> one core row per expected model.

    One scan reads all files that exist (a path is a file, or a folder that a writer filled); each row
    knows its file, and the expected models are left-joined to the files by path or by folder. A
    model whose file is missing gets a row of nulls, so comparisons report it instead of failing. Which files
    exist is asked once for each parent folder.
    """
    uris = {m: _qualified(spark, p) for m, p in paths.items()}
    present = _present(spark, sorted(set(uris.values())))
    expected = spark.createDataFrame([(m, _path_of(u)) for m, u in uris.items()], "model string, _path string")
    if not present:
        return core_table(expected.select("model", F.lit(None).cast("string").alias("json")), keep=["model"])
    with packed_scan(spark):
        raw = spark.read.text(present, wholetext=True).select(_local_path(_decoded_path()).alias("_file"), F.col("value").alias("json"))
        raw = materialize(raw, "metrics_files")  # small records, parsed and joined below
    by_path = raw.select(F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]*$", ""))).alias("_path"), "json")
    return core_table(expected.join(by_path, "_path", "left").select("model", "json"), keep=["model"])


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with its scheme and authority, not encoded."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString()


def _path_of(uri: str) -> str:
    """A URI without its scheme and authority (as ``_local_path``)."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", uri)


def _present(spark: SparkSession, uris: list[str]) -> list[str]:
    """Those of the URIs that exist, by one listing of each parent folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, list[str]] = {}
    for u in uris:
        folders.setdefault(u.rsplit("/", 1)[0] or "/", []).append(u)
    out = []
    for folder, wanted in folders.items():
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            found = {s.getPath().getName() for s in fs.listStatus(path)}
            out += [u for u in wanted if u.rsplit("/", 1)[1] in found]
    return out
