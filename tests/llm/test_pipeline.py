"""The pipeline's stages: each stage's contract on its own input, the run as their composition."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in pipeline.STAGES:
        new = stage(spark, docs, SF)
        assert new.columns == columns
        rows = new.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(rows, docs.schema)
    got = pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, n int, kept string"
    rows = [(None, None, None, None, None, "a", 1, "x"), (1, "", "en", None, 0, "b", 2, "y"), (1, "", "en", None, 0, "b", 2, "y"), (2, "word " * 60, None, "s", 300, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()


def test_no_stub_leaves_line_dedup(spark):
    line = "this line of many words stands in every copy of a document and so it goes from all but one"
    own = "\n".join(f"{line} number {'abcdefgh'[i]}" for i in range(4))
    docs = spark.createDataFrame([(i, own + ("\nand one word more" if i == 2 else ""), "en", "s", 0) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.line_deduplication(spark, docs, SF).collect()
    assert [r.doc_id for r in left] == []  # four lines of one template: the first line is all that would stay, too
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}" for i in range(80)]
    docs = spark.createDataFrame([(i, " ".join(words) + f"\n{line}", "en", "s", 0) for i in range(3)], docs.schema)
    left = pipeline.line_deduplication(spark, docs, SF).collect()
    assert [(r.doc_id, len(r.text.split())) for r in left] == [(0, 80 + len(line.split()))]


def test_run_leaves_no_tables_of_stages_behind(spark):
    import pathlib

    folder = pathlib.Path(pipeline.common.shared_dir(spark).removeprefix("file://")) / "framelode"
    before = set(folder.iterdir()) if folder.exists() else set()
    pipeline.run(spark, SF).collect()
    assert len(set(folder.iterdir()) - before) <= 1
