"""The operators against plain versions of themselves, on small tables with nulls, empty and repeated rows and clashing columns."""
from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from alertloom.llm import (arrow_sequences, avi_clips, bpe_prefix, common, line_edit, pfair_mix, quality_ratio, secret_owners, simhash_tiles,
                           sparse_suffix, warc_chain)

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "a", "A b", "one two three four", "One  two three four", "é漢字 😀 it's\n\n x", "  ", "w " * 400, "<|endoftext|> a.b,c.", "the end.\n"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(200)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 120))).replace(" ", "\n", rnd.randrange(4))) for i in range(60)]
    for i in range(60, 90):  # near and exact copies
        words = rows[rnd.randrange(60)][1].split(" ")
        if i % 3:
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += list(enumerate(TEXTS, 90)) + [(5, rows[5][1]), (None, "one two three four"), (None, None)]
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 7 else None, "x", 1) for i, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, line string, n_words int")
    return frame, [(i, t) for i, t, *_ in rows]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, line string, n_words int")


def naive_fingerprint(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(found[i:i + 3]) for i in range(max(len(found) - 2, 1))] if found else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_simhash(corpus, empty):
    docs, rows = corpus
    got = {(r.doc_id, r.fp % 2 ** 64): r.component_id for r in simhash_tiles.near_copies(docs, tile=8).collect()}
    prints = {naive_fingerprint(t) for _, t in rows}
    root = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    first = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            first[root[naive_fingerprint(t)]].append(i)
    assert got == {(i, naive_fingerprint(t)): min(first[root[naive_fingerprint(t)]]) for i, t in rows}
    kept = simhash_tiles.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got.values()) | {None}
    assert simhash_tiles.near_copies(empty).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (60, 50), (50, 70), (60, 50)], "a long, b long")
    assert {r.node: r.root for r in common.components(edges).collect()} == {k: 0 for k in range(41)} | {50: 50, 60: 50, 70: 50}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_quality(spark, corpus, empty):
    docs, rows = corpus
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i == 9)) for i in range(0, 60)] + [(None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    buckets, threshold = 512, 0.0
    good = {i for i in range(60) if i % 4 and i not in (9, 1)}
    first = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)

    def grams(text):
        t = re.findall(r"\w+|[^\w\s]+", text or "")
        return [signed(first(a)) % buckets for a in t] + [signed(xxhash.xxh64_intdigest(b.encode(), first(a))) % buckets for a, b in zip(t, t[1:])]
    raw, trusted = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            trusted.update(grams(t))
    share = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + buckets))
    weight = {b: round(1e6 * (share(trusted, b) - share(raw, b))) for b in raw}
    want = collections.Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = collections.Counter(zip(w, w[1:], w[2:]))
        again = {p for k, x in enumerate(zip(w, w[1:], w[2:])) if wins[x] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        g = grams(t)
        score = math.floor(sum(weight[b] for b in g) / len(g) + 0.5) if g else 0
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), failed, not failed and score >= 0] += 1
    verdicts = quality_ratio.judge(docs, labels, buckets, threshold)
    got = collections.Counter((r.doc_id, *[r._verdict[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
                              for r in verdicts.collect())
    assert got == want
    kept = quality_ratio.keep_good(docs, labels, buckets=buckets, threshold=threshold)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if k[-1])
    assert quality_ratio.judge(empty, labels).count() == 0
    assert {r.s for r in quality_ratio.judge(docs, labels.limit(0)).select(F.col("_verdict.score").alias("s")).collect()} == {0}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_line_links(spark, radius):
    rnd = random.Random(radius)
    lines = set()
    for _ in range(40):
        start = "".join(rnd.choice("abcé😀") for _ in range(rnd.randrange(9, 18)))
        for _ in range(4):
            b = list(start)
            for _ in range(rnd.randrange(0, 5)):
                k = rnd.randrange(len(b))
                b[k:k + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
            lines.add("".join(b))
    lines = sorted(x for x in lines if len(x) > radius)
    frame = spark.createDataFrame([(k % 7, x) for k, x in enumerate(lines)], "doc long, line string")
    hashes = {xxhash.xxh64_intdigest(x.encode(), 42): x for x in lines}
    got = collections.Counter(frozenset((hashes[r.hash_a % 2 ** 64], hashes[r.hash_b % 2 ** 64])) for r in line_edit.links(frame, radius).collect())
    assert got == collections.Counter(frozenset((a, b)) for k, a in enumerate(lines) for b in lines[:k] if edits(a, b) <= radius)


def test_letter_counts_wrap(spark):
    """Counts beyond 127 and 255 of a letter neither overflow nor part lines within the radius."""
    body = "0123456789" * 3
    lines = [body + letter * n + "-" * 20 for letter in "er" for n in (0, 127, 128, 129, 255, 256, 257, 300)]
    found = {(a, b) for k, a in enumerate(lines) for b in lines[k + 1:] if a != b and edits(a, b) <= 2}
    frame = spark.createDataFrame([(k, line) for k, line in enumerate(dict.fromkeys(lines))], "doc long, line string")
    names = dict(enumerate(dict.fromkeys(lines)))
    got = {frozenset((names[r.doc_a], names[r.doc_b])) for r in line_edit.links(frame, 2).collect()}
    assert got == {frozenset(pair) for pair in found} and len(got) == 12


def test_line_dedup(spark, empty):
    rows = [(1, "first long line here\nshort\nfirst long line here\nown line of one"), (2, "first long line here\nshort\nfirst long lime here"), (3, "short"),
            (4, None), (5, ""), (None, "first long line here"), (6, "own line of 1ne\n\ntail")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r.text for r in line_edit.dedup(docs, 2, 10).collect()}
    assert got == {1: "first long line here\nshort\nown line of one", 2: "short", 3: "short", 4: None, 5: "", None: "first long line here", 6: "\ntail"}
    counts = {r.doc_id: tuple(r)[1:] for r in line_edit.report(docs, 2, 10).collect()}
    assert counts[1] == (4, 1, 0, 0, 2) and counts[2] == (3, 0, 1, 1, 2) and counts[4] == (0, 0, 0, 0, 0) and counts[6] == (3, 0, 0, 1, 1)
    assert line_edit.report(empty).count() == 0 and line_edit.dedup(empty).count() == 0


@pytest.mark.parametrize("least, gram", [(8, 3), (6, 6)])
def test_passages(spark, empty, least, gram):
    rnd = random.Random(least)
    shared = [[rnd.choice("abcd") for _ in range(rnd.randrange(4, 25))] for _ in range(20)]
    rows = [(i, " ".join(sum((rnd.choice([rnd.choice(shared), [rnd.choice("abcdefghij") for _ in range(5)]]) for _ in range(rnd.randrange(1, 8))), [])))
            for i in range(120)]
    rows += [(500 + i, rows[i][1]) for i in range(5)] + [(600, ""), (601, None), (None, rows[9][1]), (602, "a " * 30)]
    seen, held = collections.defaultdict(set), collections.Counter(t or "" for _, t in rows)
    split = lambda t: (t or "").split()
    for _, t in rows:
        w = split(t)
        for s in range(len(w) - least + 1):
            seen[tuple(w[s:s + least])].add(t)
    want = collections.Counter()
    for i, t in rows:
        w, run = split(t), None
        for s in [s for s in range(len(w) - least + 1) if held[t] > 1 or len(seen[tuple(w[s:s + least])]) > 1] + [1 << 30]:
            if run and s > run[1]:
                want[i, run[0], run[1], len(w)] += 1
                run = None
            run = (run[0] if run else s, s + least)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int")
    assert collections.Counter(map(tuple, sparse_suffix.passages(docs, least, gram).collect())) == want
    assert sparse_suffix.passages(empty).count() == 0


def test_warc(spark):
    fake = "x\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nyy\r\n\r\n"
    rows = [(1, "u v\r\nw", fake), (2, None, None), (None, "y", ""), (3, "", ""), (3, "", ""), (4, "u", fake), (5, "u", "é" * 9), (0, "u", "é" * 9)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    for least in (0, 1):
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        want = collections.Counter()
        for i, _, h in rows:
            body = (h or "").encode()
            again = len(body) >= least and i != first[h or ""]
            want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
        got = warc_chain.read(spark, warc_chain.write(pages, least=least, per_file=3)).collect()
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all(r.digest_ok for r in got)
    assert warc_chain.read(spark, warc_chain.write(pages.limit(0))).count() == 0


def test_byte_bpe(corpus, empty):
    docs, rows = corpus
    ranks = bpe_prefix.ranks(RANKS, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab e'st\n\t \xa0　é漢😀12<|>\x00\x1c\x85") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    ids, counts = bpe_prefix.encoded(pa.array(texts), ranks, bpe_prefix.coder(ranks))
    assert np.split(ids, np.cumsum(counts)[:-1])[-1].tolist() == plain.encode_ordinary(texts[-1])
    assert ids.tolist() == [i for t in texts for i in plain.encode_ordinary(t)]
    want = collections.Counter()
    for i, t in rows:
        own = plain.encode_ordinary(t or "")
        want[i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe_prefix.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert bpe_prefix.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefixes_append_and_edit():
    ranks, rnd = bpe_prefix.ranks(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(300):
        data, more = (bytes(rnd.choice(b"abethrsing ") for _ in range(rnd.randrange(60))) for _ in range(2))
        whole, grown = bpe_prefix.Prefixes(ranks, data + more), bpe_prefix.Prefixes(ranks, data)
        grown.append(more)
        assert grown.last == whole.last and ranks.decode(grown.ids()) == data + more
        at = rnd.randrange(len(data + more) + 1)
        cut = rnd.randrange(len(data + more) - at + 1)
        grown.edit(at, cut, b"thing")
        assert grown.last == bpe_prefix.Prefixes(ranks, grown.data).last
    long_ = bpe_prefix.Prefixes(ranks, b"the thing in the string " * 200)
    assert long_.edit(50, 3, b"xyz") < 400


def test_sequences(spark, corpus, empty):
    docs, rows = corpus
    tokens = Tokenizer.from_file(WORDS)  # the library as it comes
    special = ["<|endoftext|>", "a<|endoftext|>b.", "<|ENDOFTEXT|> x<|EndOfText|>", "end. <|endoftext|>, <|startoftext|><|endoftext|>.,", "<|endoftext |>", "É<|endoftext|>É. <|É", "<|a.b|>."]
    more = [(2000 + k, t) for k, t in enumerate(special)]
    rows = rows + more
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    manifest = arrow_sequences.write(docs, WORDS, length=16)
    got = sorted(map(tuple, arrow_sequences.read(manifest).collect()), key=lambda r: r[1])
    start, want = 0, collections.Counter()
    ids = {t: tokens.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    for doc, at, n, crc in got:
        assert at == start
        start += n
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for i, t in rows:
        want[i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())] += 1
    assert collections.Counter((d, n, c) for d, _, n, c in got) == want
    first = manifest.orderBy("part").first()
    values, mask = arrow_sequences.sequence(first.path, 0)
    assert len(values) == len(mask) == 16 and values.base is not None
    assert arrow_sequences.read(arrow_sequences.write(empty, WORDS)).count() == 0


def test_media(corpus, empty):
    docs, rows = corpus
    files = avi_clips.media(docs)
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in avi_clips.digests(files).collect())
    want = collections.Counter()
    for i, t in rows:
        body = (t or "").encode()
        padded = body.ljust(max(192, -(-len(body) // 192) * 192), b" ")
        want[i, len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])] += 1
    assert got == want
    assert avi_clips.digests(avi_clips.media(empty)).count() == 0
    noise = np.random.default_rng(1).integers(0, 256, (9, 192), dtype=np.uint8)
    assert (avi_clips.decode_frames(avi_clips.read_avi(avi_clips.write_avi(avi_clips.encode_frames(noise)))[1]) == noise).all()
    still = np.concatenate([np.full((5, 192), 40, np.uint8), np.full((4, 192), 200, np.uint8)])
    assert avi_clips.cuts(still).tolist() == [5]
    spans = collections.defaultdict(list)
    for r in avi_clips.clips(files).where("doc_id = 98").collect():
        spans[r.clip] = (r.start_ms, r.end_ms)
    assert spans[0][0] == 0 and max(e for _, e in spans.values()) == -(-800 // 192) * 40


def test_secrets(spark, empty):
    key, hexa = "AKIA" + "Q1" * 9, "0f" * 13
    rows = [(1, f'password = "hunter22"; {key} {hexa} secret=token:abcdefgh', "a"), (2, f"x API_KEY:'{hexa}'", "b"), (3, "token=short token = abc", "a"),
            (4, None, None), (5, "", "a"), (6, "é😀 Passwd: zZ9/zZ9/zz", "c"), (6, "é😀 Passwd: zZ9/zZ9/zz", "c"), (7, f"{hexa}A {hexa}", "b"), (8, "k: aB3" + "xY7z" * 6, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, kind int")
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    got = secret_owners.scan(docs).collect()
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id) or ""
        base = ([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
                + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        shown = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == shown
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_live == 2 and by[2].n_live == 0 and by[7].n_examples == 2 and by[8].n_live == 1 and by[6].n_live == 1
    assert secret_owners.scan(empty).count() == 0


def test_mix(corpus, empty, spark):
    docs, rows = corpus
    placed = pfair_mix.schedule(docs, alpha=0.5, block=2, period=16)
    assert placed.columns == [*docs.columns, "_mix"]
    got = placed.select("source", "doc_id", "_mix.*").collect()
    assert len(got) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert max(collections.Counter((r.slot, r.place) for r in got).values()) == 1
    assert len({r.slot for r in got}) == len({(r.source, r.block) for r in got})
    for shares in ({"a": 1, "b": 6, "c": 9}, {"a": 5, "b": 5, "c": 6}):
        taken = collections.Counter()
        for s, _, slot, _, _ in pfair_mix.earliest_deadlines(shares, 16):
            taken[s] += 1
            assert all(abs(taken[x] - a * (slot + 1) / 16) < 1 for x, a in shares.items())
    mixed = pfair_mix.mixed(docs)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert pfair_mix.schedule(empty).count() == 0
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError):
        pfair_mix.schedule(many)
