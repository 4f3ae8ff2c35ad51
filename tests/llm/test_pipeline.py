"""The pipeline against its stages applied one by one, and its stages' columns."""

import os

import pytest
from pyspark.sql import functions as F

from .test_set_join import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p
    from delimkit.llm import decontaminate, toxicity
    from delimkit.llm.secret_scan import redact, scan_text

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r.doc_id: r for r in p.run(spark, SF).collect()}
    clean = toxicity.score_toxicity(docs, labels).where("predicted = 0").select("doc_id")
    docs = docs.join(clean, "doc_id", "left_semi")
    one = [d for d, _, low in brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 80) if d == low]
    docs = docs.where(F.col("doc_id").isin(one))
    fine = decontaminate.contamination(docs, items, least=1).where("not contaminated").select("doc_id")
    rows = docs.join(fine, "doc_id", "left_semi").select("doc_id", "text").collect()
    assert sorted(got) == sorted(r.doc_id for r in rows)
    import hashlib

    for r in rows:
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(redact(r.text, scan_text(r.text)[1]).encode()).hexdigest()


def test_stages_keep_columns(spark, edge, labels, tmp_path):
    import corpus_pipeline as p

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (edge, edge.limit(0)):
        docs = start
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == edge.columns
        assert p.STAGES[-1][1](spark, docs, str(tmp_path)).where(F.col("n_pieces") < 0).count() == 0


def test_run_drops_a_document_with_one_whole_item(spark, tmp_path):
    import corpus_pipeline as p

    item, other = (" ".join(f"{w}{i}" for i in range(20)) for w in ("alpha", "beta"))
    rows = [(1, f"some words before {item} and some after", "en", "s", 0), (2, "a clean text of other words", "en", "s", 0), (3, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == [2, 3]
