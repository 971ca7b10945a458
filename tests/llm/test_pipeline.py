"""The pipeline stages on an awkward table: columns, nulls, empties, and what each stage decides."""

import corpus_pipeline
from test_operators import DOCS, awkward


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.createDataFrame(awkward(), DOCS)
    bench = spark.createDataFrame([(1, "changed alpha")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "decontamination", "mixing"]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        if number < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{tmp_path}/{number}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text), (1, text), (2, text.replace("word5 ", "other ")), (4, text[::-1]), (1, text), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "None"]


def test_passages_are_cut(spark, tmp_path):
    passage = " ".join(f"Test{i}" for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"before {passage} after", 9), (2, passage, 9), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert kept == {1: ("before  after", 13), 3: ("clean", 5)}
