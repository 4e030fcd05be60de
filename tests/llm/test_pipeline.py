"""The pipeline's stages, each against its own input."""

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from brute import jaccard_components, removed_bytes

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = pipeline.materialize(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name != "source_mixing":
            assert out.columns == docs.columns
        if name == "ngram_jaccard_join":
            want = jaccard_components([(d, r["text"]) for d, r in before.items()], 5, 80)
            assert set(after) == {d for d, (_, c) in want.items() if c == d}
        if name == "suffix_array_dedup":
            want = removed_bytes([(d, r["text"]) for d, r in before.items()], 100)
            assert set(after) == set(before)
            assert all(len(before[d]["text"].encode()) - len(r["text"].encode()) >= want[d][1] for d, r in after.items())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name in ("quality_classifier", "ngram_jaccard_join", "benchmark_decontamination"):
            assert all(after[d] == before[d] for d in after)  # kept rows are whole
        docs = out


def test_stages_on_edge_rows(spark, edge, nothing):
    cols = list(pipeline.COLUMNS)
    for start in (edge.select(cols), nothing.select(cols)):
        docs = start
        for name, stage in pipeline.STAGES:
            docs = pipeline.materialize(stage(spark, docs, SF), f"edge_{name}")
        assert docs.count() <= start.count()


def test_each_stage_alone_with_clashing_columns(spark, edge, nothing):
    """Every stage gets the edge rows as they are: null and repeated ids, a very long text, extra columns named like internal ones."""
    for name, stage in pipeline.STAGES:
        out = stage(spark, edge, SF)
        if name != "source_mixing":
            assert out.columns == list(pipeline.COLUMNS), name
        rows = out.collect()
        assert len(rows) <= edge.count() and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in edge.collect()}, name
        if name == "suffix_array_dedup":
            assert len(rows) == edge.count()
        if name == "ngram_jaccard_join":
            assert sum(r["doc_id"] in (4, 5) for r in rows) == 1 and sum(r["doc_id"] in (7, 8) for r in rows) == 1
        assert stage(spark, nothing, SF).count() == 0, name


def test_run_and_registration(spark):
    assert pipeline.run(spark, SF).count() > 0
    names = entry.queries()
    assert "pipeline" in names and sorted({n.split("_")[0] for n in names if n.startswith("op")}, key=lambda x: int(x[2:])) == [f"op{i}" for i in range(1, 14)]
