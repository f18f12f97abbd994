"""Snapshot generations and sectioning of large manuals."""
from __future__ import annotations

import time

import pytest

from alertloom.operators import manual
from alertloom.sources import snapshots, tables


def test_generations(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda n: {"a": spark.range(n), "b": spark.range(2 * n).withColumnRenamed("id", "k")}
    with pytest.raises(snapshots.TornSnapshot):
        snapshots.read_snapshot(spark, path)
    for n in (1, 2, 3, 4):
        tables.write_snapshot(rows(n), path, f"s{n}")
    spark.range(9).write.parquet(f"{path}/gen=s0/a")  # torn and old
    spark.range(9).write.parquet(f"{path}/gen=s9/a")  # being written
    assert [(g.stamp, g.committed) for g in snapshots.generations(spark, path)] == [("s0", False), ("s1", True), ("s2", True), ("s3", True), ("s4", True), ("s9", False)]
    with pytest.raises(snapshots.TornSnapshot):
        snapshots.read_snapshot(spark, path, "s9")
    with snapshots.reading(spark, path, "s1", 100):
        assert [g.stamp for g in snapshots.generations(spark, path) if g.leased] == ["s1"]
        assert snapshots.expire(spark, path, 2) == ["s0", "s2"]
        assert snapshots.expire(spark, path, 2, now=time.time() + 200) == ["s1"]  # the lease has run out
    assert snapshots.expire(spark, path, 1) == ["s3"]
    assert {n: df.count() for n, df in snapshots.read_snapshot(spark, path).items()} == {"a": 4, "b": 8}
    spark.range(1).withColumnRenamed("id", "k").write.mode("append").parquet(f"{path}/gen=s4/b")
    with pytest.raises(snapshots.TornSnapshot, match="in b"):
        snapshots.read_snapshot(spark, path)
    with pytest.raises(ValueError):
        snapshots.expire(spark, path, 0)


def test_sectioning_is_linear_in_the_blocks(spark):
    def seconds(n):
        text = "# Head\n" + "".join(f"line {k}\n```sh\necho {k}\n# no head\n```\n" + ("## Part\n" if k % 50 == 0 else "") for k in range(n))
        frame = spark.createDataFrame([("f.md", text)], "file string, text string")
        began = time.time()
        rows = manual.split_sections(frame).collect()
        assert len(rows) == 1 + (n + 49) // 50 and sum(r.text.count("echo") for r in rows) == n
        return time.time() - began
    seconds(100)
    small, large = seconds(2000), seconds(20_000)
    assert large < 20 * max(small, 0.5)
    assert seconds(100_000) < 60
