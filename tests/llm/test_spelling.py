"""Spelling variants against all pairs, on words that collide, repeat and stretch."""
from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import pytest

from alertloom.llm import pivot_grams, queries

SMALL = "/root/testdata/sf0.001"


def read(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:code % len(run)] + run[code % len(run) + 1:] if code % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, alike=one_edit):
    n = read(rows)
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if alike(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def rows_of(frame):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    letters = ["ab", "abcdefghijé", "aÀÿ×z"][seed]
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 13))) for _ in range(25)]
    for _ in range(250):
        w = rnd.choice(words)
        at = rnd.randrange(len(w) + 1)
        words.append(rnd.choice([w[:at] + rnd.choice(letters) + w[at:], w[:at] + w[at + 1:], w[:at] + rnd.choice(letters) + w[at + 1:]]) or "aaaaaaa")
    docs = []
    for i in range(120):
        docs.append((i, " ".join(w for w in rnd.choices(words, k=30) for _ in range(int(rnd.paretovariate(0.6)) % 400))))
    got = rows_of(pivot_grams.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)))
    assert len(got) == len(set(got)) and set(got) == brute(docs)


def test_defined_cases(spark):
    long = "x" * 8_000
    docs = [(None, "Address address ADDRESS, adress\tadress"), (1, None), (2, ""), (2, "address" + " adresse" * 2), (2, "address" + " adresse" * 2),
            (3, f"{long} {long} {long}y {long}y"), (7, " ".join(["q" * 64, "q" * 65] * 2)), (4, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ short short")]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert set(rows_of(pivot_grams.groups(frame))) == brute(docs)
    assert pivot_grams.groups(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pivot_grams.groups(frame, least=3)


def test_chain_of_forms_is_followed(spark):
    docs = [(0, " ".join(["abcdefgh"] * 3 + ["abcdefgx"] * 40 + ["abcdefyx"] * 500 + ["abcdeqyx"] * 6000))]
    got = {r[0]: r[2] for r in rows_of(pivot_grams.groups(spark.createDataFrame(docs, "doc_id long, text string"), every=2 ** 33))}
    assert got == dict.fromkeys(["abcdefgh", "abcdefgx", "abcdefyx", "abcdeqyx"], "abcdeqyx")


def test_ties_go_to_the_smallest_word(spark):
    docs = [(0, " ".join(["bbbbbbbb", "bbbbbbbb"] + ["bbbbbbba"] * 30 + ["abbbbbbb"] * 30))]
    got = {r[0]: r[1] for r in rows_of(pivot_grams.groups(spark.createDataFrame(docs, "doc_id long, text string"), every=2 ** 33))}
    assert got["bbbbbbbb"] == "abbbbbbb"


def test_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op13_spelling_variants(spark, SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(rows_of(got)) == brute(rows, lambda a, b: abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_pivots_do_not_overlap():
    rnd = random.Random(5)
    for _ in range(300):
        places = sorted({rnd.randrange(12): rnd.randrange(1, 9) for _ in range(8)}.items())
        if len(places) > 2:
            chosen = pivot_grams.pivots(places)
            cost = dict(places)
            assert chosen[1] - chosen[0] >= 2
            assert sum(map(cost.get, chosen)) == min(cost[a] + cost[b] for a in cost for b in cost if b - a >= 2)
