"""Near copies by sketches against all pairs of sets."""
from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from alertloom.llm import fast_sketch, queries

SMALL = "/root/testdata/sf0.001"


def set_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=lambda s: sorted(s))
    at = {s: k for k, s in enumerate(distinct)}
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    holders = collections.defaultdict(list)
    for k, s in enumerate(distinct):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(distinct):
        shared = collections.Counter(o for x in s for o in holders[x] if o > k)
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(distinct[o]) - n):
                root[find(k)] = find(o)
    first = collections.defaultdict(list)
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            first[find(at[s])].append(i)
    out = collections.Counter()
    for (i, _), s in zip(rows, sets):
        c = min(first.get(find(at[s]), [None])) if s else i
        out[i, len(s), c, i == c] += 1
    return out


def counted(frame):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())


def family(rnd, size, copies, change):
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(change):
            words[rnd.randrange(size)] = f"c{rnd.randrange(10 ** 6)}"
        yield " ".join(words)


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    texts = [t for size, change in ((5, 0), (8, 1), (40, 1), (60, 2), (200, 10), (300, 30), (90, 4)) for t in family(rnd, size, 12, change)]
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(80)]
    texts += ["", None, "   ", "a", "A", "a b", "A  B\n", "a b a b a b", "w " * 5000, "😀 é É", texts[0], texts[5]]
    rows = list(enumerate(texts)) + [(3, texts[30]), (None, texts[40]), (None, "only nameless rows"), (None, "only nameless rows"), (None, None)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, keys string, n int").repartition(5)
    assert counted(fast_sketch.near_copies(frame)) == brute(rows)
    assert fast_sketch.near_copies(frame.limit(0)).count() == 0


@pytest.mark.parametrize("change", [2, 9, 14])
def test_large_group(spark, monkeypatch, change):
    """Buckets above ``SMALL`` are finished in tiles; at these rates copies are all, partly or hardly linked with each other."""
    monkeypatch.setattr(fast_sketch, "SMALL", 4)
    monkeypatch.setattr(fast_sketch, "TILE_SETS", 16)
    rnd = random.Random(change)
    rows = list(enumerate(family(rnd, 150, 130, change)))
    got = counted(fast_sketch.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert counted(queries.op12_minhash(spark, SMALL)) == brute(rows)


def test_every_bin_is_filled_and_agreement_estimates_similarity():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 5, 30, 500, 5000):
        bins = fast_sketch.sketch(rnd.integers(0, 2 ** 63, n).astype(np.uint64), 240)
        assert (bins != np.iinfo(np.uint64).max).all() and (bins >> np.uint64(40) < 480).all()
    for n in (10, 100, 2000):
        shared, own = rnd.integers(0, 2 ** 63, 8 * n).astype(np.uint64), rnd.integers(0, 2 ** 63, 2 * n).astype(np.uint64)
        a, b = (fast_sketch.sketch(np.concatenate([shared, own[k * n:(k + 1) * n]]), 240) for k in (0, 1))
        assert abs((a == b).mean() - 0.8) < 0.12


def test_intersections_by_products():
    rnd = np.random.default_rng(2)
    one, two = ([np.unique(rnd.integers(0, 400, rnd.integers(1, 200)).astype(np.int64)) for _ in range(n)] for n in (17, 9))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in two] for a in one]
    assert (fast_sketch.overlaps(one, two, block=64) == want).all()
