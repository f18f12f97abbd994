"""Helper columns of the stages against input columns of the same names."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.llm import line_edit, pfair_mix, quality_ratio

NAMES = ["_source", "_rank", "_block", "_at", "_task", "_shift", "_low", "_n", "_mix", "_file", "_row", "_start", "place", "_t1", "_t2", "_rules",
         "_score", "_grams", "_verdict", "_gone", "_doc", "c0", "c1", "doc", "line"]


def table(spark):
    rows = [(i, f"a line of text that number {i // 2} holds\nsecond line of the text, the same in all\n" + "word " * 60 + f"{i} " * 9, f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def carried(got, without=()):
    assert [c for c in got.columns if c in NAMES] == [n for n in NAMES if n not in without]
    for r in got.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES if n not in without)


def test_mix_keeps_the_input(spark, tmp_path):
    docs = table(spark)
    mixed = pfair_mix.mixed(docs)
    assert mixed.columns == docs.columns
    carried(mixed)
    mixed.write.parquet(f"{tmp_path}/mixed")
    placed = pfair_mix.places(spark.read.parquet(f"{tmp_path}/mixed"))
    carried(placed.drop("place"), ["place"])
    assert sorted(r.place for r in placed.collect()) == list(range(30))
    assert pfair_mix.schedule(docs).select("_mix.slot").count() == 30


def test_rules_keep_the_input(spark):
    docs, labels = table(spark), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_ratio.judge(docs, labels, buckets=64)
    assert got.count() == 30 and got.select("_verdict.kept").count() == 30
    kept = quality_ratio.keep_good(docs, labels, buckets=64, threshold=-100.0)
    assert kept.columns == docs.columns
    carried(kept)


def test_lines_keep_the_input(spark):
    docs = table(spark)
    got = line_edit.dedup(docs, fold=1)
    assert got.columns == docs.columns and got.count() == 30
    carried(got)
    assert sum("the same in all" in r.text for r in got.collect()) == 1
