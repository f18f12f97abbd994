"""Whole jobs: cases that a cut would lose."""
from __future__ import annotations

import collections
import functools
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from alertloom.llm import line_edit, pfair_mix, simhash_jaccard

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    found = text.lower().split()
    return {tuple(found[i:i + 5]) for i in range(max(len(found) - 4, 1))}


def test_stage_links_pairs_from_80_percent(spark):
    """Pairs at 0.8 to 0.95 by brute force: the stage keeps the first document of every group, and no other is lost."""
    rnd = random.Random(5)
    texts = []
    for _ in range(150):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for _ in range(rnd.randrange(1, 1 + len(words) // 35)):
                other[rnd.randrange(len(other))] = f"n{rnd.randrange(9999)}"
            texts.append(" ".join(other))
    texts += ["", "  ", "a b", "A  b"]
    sets = [shingle_set(t) if t.split() else set() for t in texts]
    up, mid = list(range(len(texts))), 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for j in range(len(texts)):
        for i in range(j):
            union = len(sets[i] | sets[j])
            s = len(sets[i] & sets[j]) / union if union else 1
            if s >= 0.8:
                mid += s <= 0.95
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert mid > 100
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    want = {root(i) for i in range(len(texts))}
    for tile in (64, 4096):
        kept = [r.doc_id for r in simhash_jaccard.keep_similar(docs, tile=tile).collect()]
        assert len(kept) == len(want) + 1 and set(kept) == want | {None}
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == want | {None}


def test_stage_sends_a_set_a_bounded_number_of_times(spark, monkeypatch):
    """Tiles meet by the sizes of their sets, and a cell of any size is cut into a few: every tile was sent to every other."""
    rnd = random.Random(9)
    texts = [" ".join(f"w{rnd.randrange(9999)}" for _ in range(5 + int(2 ** (k % 9)))) for k in range(1800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kind, sent = type(docs), []
    whole = kind.mapInArrow

    def counted(df, *args, **options):
        if df.columns == ["a", "b"]:
            sent.append(df.agg(F.sum(F.greatest(F.size("a"), F.lit(0)) + F.greatest(F.size("b"), F.lit(0)))).first()[0] or 0)
        return whole(df, *args, **options)
    monkeypatch.setattr(kind, "mapInArrow", counted)
    assert simhash_jaccard.keep_similar(docs, tile=8).count() == len(texts)
    assert 0 < max(sent) <= 32 * len(texts)


def test_tiles_skip_only_pairs_whose_sizes_forbid_them():
    """Against all pairs: the candidates of tiles in blocks are the pairs within the radii whose sizes allow 0.8."""
    rnd = np.random.default_rng(4)
    base = rnd.integers(-2 ** 63, 2 ** 63 - 1, (30, simhash_jaccard.WORDS))

    def tile(n, first):
        prints = base[rnd.integers(0, 30, n)] ^ (1 << rnd.integers(0, 62, (n, simhash_jaccard.WORDS)))
        return simhash_jaccard.Tile(pa.StructArray.from_arrays([pa.array(first + np.arange(n)), pa.array(rnd.integers(0, 40, n)), *map(pa.array, prints.T)],
                                                               names=["node", "size", *[f"f{k}" for k in range(simhash_jaccard.WORDS)]]))
    one, two = tile(300, 0), tile(200, 1000)
    for a, b in ((one, two), (two, one), (one, one)):
        i, j = simhash_jaccard.close(a.prints, b.prints)
        want = {(x, y) for x, y in zip(i.tolist(), j.tolist()) if (a is not b or x < y) and min(a.size[x], b.size[y]) >= 0.8 * max(a.size[x], b.size[y])}
        got = [x for p in simhash_jaccard.candidates(a, b, 0.8, rows=16, wide=32) for x in zip(*(v.tolist() for v in p))]
        assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100
        links = simhash_jaccard.spanned(a, b, 0.8)
        assert len(links) <= len(a.size) + len(b.size) and {n for x in links for n in x} <= {*a.node.tolist(), *b.node.tolist()}


def test_mix_follows_the_given_weights():
    """In every prefix of the first phase each source is less than a block from its exact share, across ranges."""
    rnd = random.Random(3)
    cases = [{f"s{k}": 0.5 if k == 0 else 0.5 / 19 * rnd.uniform(0.5, 1.5) for k in range(20)}, {"a": 1 / 3, "b": 2 / 3 - 0.0005, "c": 0.0005},
             {f"s{k}": (k + 1) ** 0.5 for k in range(40)}, {f"s{k}": rnd.random() ** 4 + 0.02 for k in range(60)}, {f"s{k}": 1.0 for k in range(257)}]
    for weights in cases:
        shares = [*pfair_mix.whole(weights).values()]
        phase = pfair_mix.Phase([*weights], shares, [0] * len(shares), 0, 6000)
        total, taken, at = sum(map(Fraction, weights.values())), collections.Counter(), 0
        n = pfair_mix.ranges(phase, 16)
        for nth in range(n):
            for s, block, slot, release, deadline in pfair_mix.dealt(phase, nth, 16):
                assert block == taken[s] and slot == at and release <= slot < deadline
                taken[s] += 1
                at += 1
                if at % 7 == 0 or at < 300:
                    assert all(abs(taken[x] - Fraction(w) / total * at) < 1 for x, w in weights.items())
        assert at == 6000 and (n > 1 or len(weights) == 3)


def test_mix_takes_many_sources(spark):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("source"))
    got = pfair_mix.schedule(rows, block=2, most_sources=None).select("_mix.*").collect()
    assert len(got) == 900 and sorted({r.slot for r in got}) == list(range(600))


def test_mixing_decides_places(spark, monkeypatch, tmp_path):
    """The last stage returns the places of the schedule, however the files are read; other weights give other places."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b")).coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    stages, whole, found = dict(corpus_pipeline.STAGES), pfair_mix.mixed, []
    for k, alpha in enumerate((0.5, 3.0)):
        monkeypatch.setattr(pfair_mix, "mixed", functools.partial(whole, alpha=alpha))
        stages["mixing sources to target weights"](spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        got = stages["byte-level BPE encoding and decoding"](spark, spark.read.parquet(f"{tmp_path}/{k}"), SF)
        found.append({r.doc_id: r.place for r in got.collect()})
        slots = pfair_mix.schedule(docs, alpha=alpha).orderBy("_mix.slot", "_mix.place").select("doc_id").collect()
        assert found[-1] == {r.doc_id: n for n, r in enumerate(slots)}
    assert found[0] != found[1]


LINES = [(1, "a long enough line of one\nshort\n\nshort\n  "), (2, "a long enough line of 1ne\nshort\n\n  "), (3, "another line that two have\nx"),
         (4, "short\nown line, only in four"), (5, "y\nanother line that two have"), (7, "a long enough line of 1n\n"), (None, "short"), (9, None)]


def test_short_equal_lines_go(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_edit.dedup(docs, 1, 20, fold=1).collect()}
    assert got == {1: "a long enough line of one\nshort\n\n  ", 2: "\n  ", 3: "another line that two have\nx", 4: "own line, only in four",
                   5: "y", 7: "", None: "short", 9: None}


def test_line_classes(spark):
    """Class ids from equal lines and from chains of links; counts of short equal lines without classes by them."""
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    got = {r.doc_id: (r.n_inner, r.n_equal, r.n_near, r.n_links, r.class_id) for r in line_edit.classes(docs, 1, 20, fold=1).collect()}
    assert got == {1: (1, 0, 0, 1, 1), 2: (0, 1, 1, 2, 1), 3: (0, 0, 0, 0, 3), 4: (0, 1, 0, 0, 4), 5: (0, 1, 0, 0, 3), 7: (0, 0, 1, 1, 1),
                   None: (0, 0, 0, 0, None), 9: (0, 0, 0, 0, 9)}
