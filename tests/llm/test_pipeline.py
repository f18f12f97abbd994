"""The pipeline: each stage on what its predecessor kept, against plain versions of the decisions."""
from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want
    assert "pipeline" in entry.queries()
