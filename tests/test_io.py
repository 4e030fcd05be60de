import json
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.labels import label_dimension
from corpusflow.plans.prepare import prepare
from corpusflow.sources import corpus as src
from corpusflow.sources import sinks
from paths import SF_SMALL


def _write_folders(spark, root, n=30):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(n).collect()
    for r in docs:
        d = os.path.join(root, "Cancer" if r.doc_id % 2 else "Non-Cancer")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, f"{r.doc_id}.txt"), "w", encoding="utf-8") as f:
            f.write("  " + r.text + "\n")
    os.makedirs(os.path.join(root, "Cancer", "nested"), exist_ok=True)
    with open(os.path.join(root, "Cancer", "nested", "999.txt"), "w") as f:
        f.write("deeper file, not read")
    with open(os.path.join(root, "Cancer", "notes.md"), "w") as f:
        f.write("not a txt")
    with open(os.path.join(root, "Cancer", "bad bytes+1.txt"), "wb") as f:
        f.write(b"ok \xff\xfe text")
    return docs


def test_read_class_folders(spark, tmp_dir):
    root = os.path.join(tmp_dir, "Dataset")
    docs = _write_folders(spark, root)
    df = src.read_class_folders(spark, root, required=["Cancer", "Non-Cancer"])
    rows = {r.abstract_id: r for r in df.collect()}
    assert len(rows) == len(docs) + 1
    assert rows["bad bytes+1"].text == "ok  text" and rows["bad bytes+1"].filepath.endswith("bad bytes+1.txt")
    d0 = docs[0]
    assert rows[str(d0.doc_id)].text == d0.text.strip() and rows[str(d0.doc_id)].label == "Non-Cancer"
    try:
        src.read_class_folders(spark, root, required=["Cancer", "Other"])
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_prepare_write_read_round_trip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "Dataset")
    _write_folders(spark, root)
    prepared, dim = prepare(src.read_class_folders(spark, root))
    assert {r.label: r.label_id for r in dim.collect()} == {"Cancer": 0, "Non-Cancer": 1}
    out = os.path.join(tmp_dir, "processed")
    sinks.write_prepared(prepared, out + "/parquet")
    sinks.write_prepared(prepared, out + "/csv", fmt="csv", by_split=False)
    sinks.write_label_map(dim, out + "/label_map")
    back = src.read_prepared(spark, out + "/parquet", split="test")
    assert back.count() == prepared.where(F.col("split") == "test").count()
    csv = src.read_prepared_csv(spark, out + "/csv")
    assert sorted(csv.select("abstract_id", "text").collect()) == sorted(prepared.select("abstract_id", "text").collect())
    lm = src.read_label_map(spark, out + "/label_map")
    assert sorted(tuple(r) for r in lm.collect()) == [("Cancer", 0), ("Non-Cancer", 1)]


def test_export_in_path_order(spark, tmp_dir):
    from corpusflow.sources.sinks import write_prepared

    df = spark.createDataFrame([(f"/c/{i:03d}.txt", i % 3) for i in range(40)][::-1], "filepath string, v int")
    write_prepared(df.repartition(4), tmp_dir + "/o", by_split=False, order_by="filepath")
    files = sorted(f for f in os.listdir(tmp_dir + "/o") if f.endswith(".parquet"))
    got = [r.filepath for f in files for r in spark.read.parquet(f"{tmp_dir}/o/{f}").collect()]
    assert got == sorted(got) and len(got) == 40


def test_csv_quotes_and_na(spark, tmp_dir):
    p = os.path.join(tmp_dir, "s.csv")
    with open(p, "w") as f:
        f.write('abstract_id,text\n1,"he said ""x, y"" end"\n2,NA\n3,"multi\nline"\n')
    got = {r.abstract_id: r.text for r in src.read_scoring_csv(spark, p).collect()}
    assert got == {"1": 'he said "x, y" end', "2": "NA", "3": "multi\nline"}


def test_scoring_csv_default_ids(spark, tmp_dir):
    p = os.path.join(tmp_dir, "noid.csv")
    with open(p, "w") as f:
        f.write("text,other\nfirst,a\nsecond,b\nthird,c\n")
    got = {r.abstract_id: r.text for r in src.read_scoring_csv(spark, p).collect()}
    assert got == {"id_0": "first", "id_1": "second", "id_2": "third"}


def test_default_ids_count_over_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    for k, n in (("a", 5), ("b", 1), ("c", 3)):
        with open(os.path.join(d, f"{k}.csv"), "w") as f:
            f.write("text\n" + "".join(f"{k}{i}\n" for i in range(n)))
    got = {r.text: r.abstract_id for r in src.read_scoring_csv(spark, d).collect()}
    rows = [f"{k}{i}" for k, n in (("a", 5), ("b", 1), ("c", 3)) for i in range(n)]
    assert got == {t: f"id_{i}" for i, t in enumerate(rows)}


def test_default_ids_unique_over_parquet_files(spark, tmp_dir):
    from corpusflow.operators.labels import with_default_ids

    path = os.path.join(tmp_dir, "two")
    spark.range(10).selectExpr("id", "concat('t', id) AS text").repartition(2).write.parquet(path)
    ids = [r[0] for r in with_default_ids(spark.read.parquet(path)).select("abstract_id").collect()]
    assert sorted(ids) == sorted(f"id_{i}" for i in range(10))


def test_default_ids_leave_texts_where_they_are(spark, tmp_dir, monkeypatch):
    from corpusflow.operators.labels import with_default_ids

    for k, n in (("b", 4), ("a", 3), ("c", 1)):
        with open(os.path.join(tmp_dir, f"{k}.csv"), "w") as f:
            f.write("text\n" + "".join(f'"{k}{i}\nsame"\n' for i in range(n)))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        numbered = src.read_scoring_csv(spark, tmp_dir)
        in_file = src.file_ordinal(spark.read.options(**src.CSV_OPTIONS).schema("text string").csv(tmp_dir), "n")
        spark.range(6).selectExpr("id", "'t' AS text").repartition(2).write.parquet(tmp_dir + "/t")
        of_parquet = with_default_ids(spark.read.parquet(tmp_dir + "/t"))
        for df in (numbered, in_file, of_parquet):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        want = sorted((f"{k}{i}\nsame", f"id_{j}") for j, (k, i) in enumerate((k, i) for k, n in (("a", 3), ("b", 4), ("c", 1)) for i in range(n)))
        assert sorted((r.text, r.abstract_id) for r in numbered.collect()) == want
        assert all(r.text[1] == str(r.n) for r in in_file.collect())
        # more files than are broadcast: the same ids by a shuffled join
        monkeypatch.setattr(src, "MAX_BROADCAST_FILES", 2)
        many = src.read_scoring_csv(spark, tmp_dir)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.text, r.abstract_id) for r in many.collect()) == want
    finally:
        spark.conf.set(key, before)


def test_class_folders_of_dotted_and_globbed_roots(spark, tmp_dir):
    for part in ("p1", "p2"):
        os.makedirs(os.path.join(tmp_dir, part, "Cancer"))
        for where in (("Cancer", "1.txt"), ("loose.txt",)):
            with open(os.path.join(tmp_dir, part, *where), "w") as f:
                f.write("text")
    one = src.read_class_folders(spark, os.path.join(tmp_dir, "p1", "."))
    assert [(r.abstract_id, r.label) for r in one.collect()] == [("1", "Cancer")]
    assert src.read_class_folders(spark, os.path.join(tmp_dir, "p*")).count() == 2


def test_preview_is_in_row_order(spark):
    from corpusflow.sources.sinks import to_display

    d = spark.createDataFrame([(f"id_{i}",) for i in range(25)], "abstract_id string")
    assert [r[0] for r in to_display(d).collect()] == ["id_0", "id_1", "id_2"]


def test_read_metrics_files_with_missing(spark, tmp_dir):
    a = os.path.join(tmp_dir, "baseline", "test_metrics.json")
    b = os.path.join(tmp_dir, "lora", "test_metrics.json")
    os.makedirs(os.path.dirname(a))
    with open(a, "w") as f:
        json.dump({"accuracy": 0.96, "f1_score": 0.9, "confusion_matrix": [[1, 0], [0, 1]]}, f, indent=2)
    got = {r.model: r for r in src.read_metrics(spark, {"baseline": a, "lora": b}).collect()}
    assert got["baseline"].accuracy == 0.96 and got["baseline"].f1 == 0.9 and got["baseline"].tp == 1
    assert got["lora"].accuracy is None


def test_text_source(spark):
    r = src.text_source(spark, "lung cancer").first()
    assert r.abstract_id == "manual_input"


def test_label_dimension_sorted(spark):
    df = spark.createDataFrame([("Non-Cancer",), ("Cancer",), ("Cancer",)], "label string")
    assert [tuple(r) for r in label_dimension(df).orderBy("label_id").collect()] == [("Cancer", 0), ("Non-Cancer", 1)]


def test_class_folders_written_and_compacted(spark, tmp_dir):
    root = os.path.join(tmp_dir, "Set")
    rows = [("1", "one\r\ntwo ", "en"), ("a+b c", "ünï", "f r"), ("%41", "", "en"), ("10", None, "en")]
    df = spark.createDataFrame(rows, "abstract_id string, text string, label string")
    assert sinks.write_class_folders(df, root) == 4 == sinks.write_class_folders(df.repartition(3), root)
    got = {(r.abstract_id, r.label): r.text for r in src.compact_class_folders(spark, root, required=["en", "f r"]).collect()}
    assert got == {("1", "en"): "one\r\ntwo", ("a+b c", "f r"): "ünï", ("%41", "en"): "", ("10", "en"): ""}
    for bad in ("a/b", "", "..", None):
        with pytest.raises(Exception, match="cannot be the name"):
            sinks.write_class_folders(spark.createDataFrame([(bad, "x", "en")], df.schema), root)


def test_class_folders_are_listed_and_read_by_tasks(spark, tmp_dir, monkeypatch):
    root = os.path.join(tmp_dir, "Se t+%41")
    files = {"en/1.txt": b"one \xff\xc3\xa4 ", "en/a+b%20c.txt": b"\n", "en/none.txt": b"", "en/_x.txt": b"x", "en/.y.txt": b"y", "en/z.csv": b"z",
             "f r/3.txt": "\ufffdthree\u2003".encode(), "f r/deep/4.txt": b"four", "_h/5.txt": b"five", "loose.txt": b"six"}
    for name, value in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(value)
    monkeypatch.setattr(src, "FILES_BATCH_BYTES", 3)
    df = src.read_class_folders(spark, root)
    assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(src, "_text_files", lambda *a: None)  # a store that only Spark reads
    assert got == sorted(map(tuple, src.read_class_folders(spark, root).collect()))
    assert [(r[0], r[1], r[2]) for r in got] == [("1", "one ä", "en"), ("3", "three", "f r"), ("a+b%20c", "", "en")]
    assert sinks.delete_files(df, "filepath", root) == 3 and not os.path.exists(os.path.join(root, "en/1.txt"))
    assert os.path.exists(os.path.join(root, "loose.txt"))
    with pytest.raises(Exception, match="is not under"):
        sinks.delete_files(spark.createDataFrame([(os.path.join(root, "loose.txt"),)], "p string"), "p", root + "/en")


def test_packed_scan_packs_small_files_and_restores(spark, tmp_dir):
    root = os.path.join(tmp_dir, "Many")
    df = spark.range(200).select(F.col("id").cast("string").alias("abstract_id"), F.lit("x").alias("text"), F.lit("c").alias("label"))
    sinks.write_class_folders(df, root)
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    loose = src.read_class_folders(spark, root).rdd.getNumPartitions()
    with src.packed_scan(spark, 1 << 10):
        packed = src.read_class_folders(spark, root).rdd.getNumPartitions()
    assert spark.conf.get(key) == before and packed <= loose


def test_export_keeps_path_order_within_splits(spark, tmp_dir):
    rows = [(str(i), "t", "c", f"/r/c/{i}.txt", 0, ["train", "val", "test"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "abstract_id string, text string, label string, filepath string, label_id int, split string").repartition(7)
    sinks.write_prepared(df, tmp_dir + "/out", order_by="filepath")
    for split in ("train", "val", "test"):
        got = [r.filepath for r in src.export_positions(spark, tmp_dir + "/out").where(F.col("split") == split).orderBy("pos").collect()]
        assert got == sorted(r[3] for r in rows if r[5] == split)


def test_many_metric_files_are_one_scan(spark, tmp_dir):
    paths = {}
    for i in range(60):
        folder = os.path.join(tmp_dir, f"run {i % 3}")
        os.makedirs(folder, exist_ok=True)
        paths[f"m{i}"] = os.path.join(folder, f"test+{i}.json")
        if i % 5:
            with open(paths[f"m{i}"], "w") as f:
                json.dump({"accuracy": i / 100, "f1": None if i == 7 else 0.5}, f)
    paths["elsewhere"] = os.path.join(tmp_dir, "no folder", "x.json")
    out = src.read_metrics(spark, paths)
    got = {r.model: (r.accuracy, r.f1) for r in out.collect()}
    assert got == {m: ((int(m[1:]) / 100, None if m == "m7" else 0.5) if m != "elsewhere" and int(m[1:]) % 5 else (None, None)) for m in paths}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
