"""Byte-level BPE by prefix dynamic programming, with exact appends and re-encoding near edits.

For every prefix of a byte string there is one token that can end its encoding: the one whose pair with the last token of
the shorter prefix no merge would break. ``Prefixes`` stores that token per prefix, so bytes can be appended at the cost of
the new bytes, and after an edit only the bytes up to the point where the stored tokens agree again are redone.

Texts are cut where a word is followed by a space; no match of the splitting pattern crosses such a place, so each distinct
piece of a batch is encoded once. Defined cases: null is the empty text with no ids; repeated rows give equal rows; a lone
surrogate cannot occur in a Spark string. Memory is bounded by the batch and by ``CACHE`` pieces in each memory.
"""
from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 400_000
CHUNK = regex.compile(r"\s*\S+|\s+")


class Memo(dict):
    """A bounded memory of results: two generations, so that what is asked often outlives the change."""

    def __init__(self, make, most: int = CACHE) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        return self.keep(key, found)

    def keep(self, key, found):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Ranks:
    """A vocabulary of byte tokens by rank, with what decides whether two tokens may stand side by side."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stands: dict[tuple[int, int], bool] = Memo(self._stands)
        self.matches: dict[str, list[int]] = Memo(lambda m: self.encode_piece(m.encode("utf-8", "surrogatepass")))

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a token that merges do not make of its own bytes."""
        if token not in self.halves:
            parts = [self.rank[bytes([c])] for c in self.bytes[token]]
            while len(parts) > 2:
                made = [self.rank.get(self.bytes[x] + self.bytes[y], 1 << 40) for x, y in zip(parts, parts[1:])]
                best = min(made)
                if best >= token:
                    break
                at = made.index(best)
                parts[at:at + 2] = [best]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined bytes keeps the border between two tokens.

        The merges on both sides of the border are undone from the latest; at each moment the two tokens at the border
        must not make a token of lower rank than the merge that is undone next.
        """
        return self.stands[left, right]

    def _stands(self, pair: tuple[int, int]) -> bool:
        (x, y), bound = pair, 1 << 40
        while True:
            joint = self.rank.get(self.bytes[x] + self.bytes[y])
            if joint is not None and joint < bound:
                return False
            one, two = len(self.bytes[x]) > 1, len(self.bytes[y]) > 1
            if not one and not two:
                return True
            # the later merge of the two was made while the other token was whole; of equal ones the left came first
            if one and (not two or x > y):
                bound, x = x, self.split(x)[1]
            else:
                bound, y = y + 1, self.split(y)[0]

    @cached_property
    def made(self) -> frozenset[int]:
        """Tokens that merges make of their own bytes."""
        return frozenset(i for i, t in self.bytes.items() if len(t) == 1 or self.split(i) is not None)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else Prefixes(self, piece).ids()

    def learn(self, texts: list[str]) -> None:
        """Encode the matches of many texts that are not remembered yet: in sorted order each goes on from the prefix that it
        shares with the one before, so a shared prefix is computed once."""
        fresh = {m for text in texts for m in self.pattern.findall(text)}
        chain = Prefixes(self)
        for data, match in sorted((m.encode("utf-8", "surrogatepass"), m) for m in fresh if m not in self.matches and m not in self.matches.old):
            whole = self.rank.get(data)
            self.matches.keep(match, [whole] if whole is not None else chain.become(data).ids())

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.matches[m]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of a growing or edited byte string."""

    def __init__(self, ranks: Ranks, data: bytes = b"") -> None:
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def _end(self, i: int) -> int:
        ranks, data, last = self.ranks, self.data, self.last
        rank, made, stands = ranks.rank, ranks.made, ranks.stands
        for a in range(i - ranks.longest if i > ranks.longest else 0, i):
            token = rank.get(data[a:i])
            if token is not None and (not a or stands[last[a], token]) and token in made:
                return token
        raise ValueError("bytes outside the vocabulary")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self._end(i))

    def become(self, data: bytes) -> Prefixes:
        """Another string, from the prefix that both have."""
        old, n = self.data, min(len(self.data), len(data))
        same = 0
        while same < n and old[same] == data[same]:
            same += 1
        self.data = data[:same]
        del self.last[same + 1:]
        self.append(data[same:])
        return self

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace bytes; returns how many prefixes were computed anew."""
        old, shift = self.last, len(inserted) - removed
        tail = self.data[at + removed:]
        self.data = self.data[:at] + inserted + tail
        self.last = old[:at + 1]
        settled = done = 0
        for i in range(at + 1, len(self.data) + 1):
            token = self._end(i)
            self.last.append(token)
            done += 1
            # a token depends on the last ``longest`` bytes and prefixes: that many agreements carry on to the end
            settled = settled + 1 if i > at + len(inserted) and token == old[i - shift] else 0
            if settled > self.ranks.longest:
                self.last += old[i - shift + 1:]
                break
        return done

    def ids(self) -> list[int]:
        found, i = [], len(self.data)
        while i:
            found.append(self.last[i])
            i -= len(self.ranks.bytes[self.last[i]])
        return found[::-1]


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat pieces that encode independently, and their number per text."""
    joined = pc.replace_substring(texts, " ", "\x00 ")
    clean = pc.and_(pc.invert(pc.match_substring_regex(texts, r"[\s\x00\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ")),
                    pc.invert(pc.match_substring(texts, "\x00")))
    cut = pc.split_pattern(pc.if_else(clean, joined, ""), "\x00")
    if pc.all(clean).as_py() is not False:
        return cut.flatten(), np.diff(cut.offsets.to_numpy())
    rows = [p.as_py() if ok else CHUNK.findall(t.as_py()) for p, ok, t in zip(cut, clean.to_pylist(), texts)]
    return pa.array([p for row in rows for p in row], pa.string()), np.array([len(row) for row in rows])


def coder(vocabulary: Ranks) -> Memo:
    """Ids of pieces as little-endian 32-bit integers."""
    return Memo(lambda piece: array("I", vocabulary.encode(piece)).tobytes())


def encoded(texts: pa.Array, vocabulary: Ranks, cache: Memo) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in order, and the number of ids per text."""
    flat, per_text = pieces(texts)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    vocabulary.learn([piece for piece in distinct if piece not in cache and piece not in cache.old])
    known = [cache[piece] for piece in distinct]
    return spread(known, coded.indices.to_numpy(), per_text)


def spread(known: list[bytes], at: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of dictionary entries: ``known`` holds each entry's ids as little-endian 32-bit integers."""
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    starts = np.cumsum(sizes) - sizes
    store = np.frombuffer(b"".join(known), "<u4")
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(total)
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    upto = np.concatenate([[0], ends])
    return store[where], np.diff(upto[bounds])


def slices(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text size (a single longer text is a part of its own)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
    group = np.cumsum(sizes) // most
    edges = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def round_trip(docs: DataFrame, path: str, pattern: str, carry: str | None = None) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode each whole text, then decode the ids. ``carry`` names a
    column of longs that is returned as well."""
    extra = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path, pattern)
        cache = coder(vocabulary)
        width = max(vocabulary.bytes) + 1
        table = [vocabulary.bytes.get(i, b"") for i in range(width)]
        for batch in (part for whole in batches for part in slices(whole)):
            ids, counts = encoded(pc.fill_null(batch.column(1), ""), vocabulary, cache)
            one, two, at = [], [], 0
            for n in counts.tolist():
                own = ids[at:at + n]
                at += n
                one.append(hashlib.sha256(own.tobytes()).hexdigest())
                two.append(hashlib.sha256(b"".join(map(table.__getitem__, own.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.string()),
                                              pa.array(two, pa.string()), *batch.columns[2:]],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(f"`{c}`").cast("long") for c in extra]).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", `{c}` long" for c in extra))


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path, pattern)
        cache = coder(vocabulary)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, counts = encoded(pc.fill_null(batch.column(1), ""), vocabulary, cache)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))],
                                             names=["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded binary`` of ``doc_id, ids``; null ids are no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path, pattern)
        for batch in batches:
            found = [vocabulary.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])
    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded binary")
