"""Token ids as Arrow files of equal-length sequences.

Documents are dealt by ranges of doc_id and written in ascending order, one file per task: record batches of two fixed-size
lists, ``ids`` (the smallest unsigned type that holds the vocabulary) and ``mask`` (false behind the end of the file). The
batches hold equal numbers of sequences and are not compressed, so that any sequence of a memory-mapped file is read without
a copy. A second Arrow file beside it names where each document starts. Files carry the task's number, are written under a
name of the attempt and then moved, so a repeated task replaces equal bytes.

Defined cases: a null text is empty and has only the end id; rows without a doc_id come first; rows that repeat a doc_id
follow each other; texts of special tokens are those tokens, as the library reads them; an empty table gives no file. Memory is
bounded by one batch of texts, ``PAGE`` sequences and ``KEPT_BYTES`` of words.
"""
from __future__ import annotations

import posixpath
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.bpe_prefix import slices, spread
from alertloom.llm.common import folder, stored

LENGTH = 2048
PAGE = 64
KEPT_BYTES, ENTRY_BYTES = 250 << 20, 160  # of the memory of words, and what an entry takes beside its letters and ids
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def layout(vocabulary: int, length: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, by its scheme."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def added(path: str) -> tuple[str, ...]:
    """Texts that the tokenizer takes as one token wherever they stand."""
    found = tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    if any(t != "".join(t.split()) for t in found):
        raise ValueError("tokens of the vocabulary that hold white space can not be found word by word")
    return found


class Memory(dict):
    """Ids of words, kept over the tasks of a worker and bounded in bytes."""
    weight = 0

    def keep(self, words: list[str], path: str) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            for word, found in zip(part, tokenizer(path).encode_batch_fast(part, add_special_tokens=False)):
                self[word] = ids = array("I", found.ids).tobytes()
                self.weight += ENTRY_BYTES + len(word) + len(ids)

    def forget(self) -> None:
        self.clear()
        self.weight = 0


@lru_cache(maxsize=2)
def memory(path: str) -> Memory:
    return Memory()


def core_of(word: str, tokens: tuple[str, ...]) -> str:
    """What of a word decides its ids, without the stops and commas behind it. A token of the vocabulary inside is found in the
    letters as they are, so such a word, or one that would become such a word in small letters, stays whole."""
    if any(t in word or t.lower() in word.lower() for t in tokens):
        return word
    core = word.rstrip(".,")
    if len(core) < len(word) and not ("a" <= core[-1:].lower() <= "z" and core[-1:].isascii()):
        return word
    return core


def encoded(texts: pa.Array, path: str, known: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch and their number per text. The tokenizer drops white space and never joins over it, so each distinct
    word between ASCII spaces is looked up once per batch. A full stop or comma behind a letter is a piece of its own and ASCII
    letters lose their case, so words that differ in these only are encoded once, too."""
    cut = pc.ascii_split_whitespace(texts)
    per_text = np.diff(cut.offsets.to_numpy())
    coded = cut.flatten().dictionary_encode()
    tokens = added(path)
    marks = tuple({t[:2] for t in tokens})
    cores, tails = [], []
    for word in coded.dictionary.to_pylist():
        odd = any(m in word for m in marks) or not word.isascii()
        core = core_of(word, tokens if odd else ())
        tails.append(word[len(core):])
        cores.append(core if odd else core.lower())
    if known.weight > KEPT_BYTES:
        known.forget()
    known.keep(list({w for w in (*cores, *tails) if w not in known}), path)
    return spread([known[c] + known[t] if t else known[c] for c, t in zip(cores, tails)], coded.indices.to_numpy(), per_text)


class Pages:
    """Cuts a stream of ids into sequences and writes them in pages."""

    def __init__(self, sink, schema: pa.Schema, length: int) -> None:
        self.writer, self.length, self.schema = pa.ipc.new_file(sink, schema), length, schema
        self.kind, self.rest = schema.field("ids").type.value_type.to_pandas_dtype(), np.empty(0, schema.field("ids").type.value_type.to_pandas_dtype())

    def _page(self, ids: np.ndarray, valid: int) -> None:
        ids = np.concatenate([ids, np.zeros(-len(ids) % self.length, self.kind)])
        mask = np.arange(len(ids)) < valid
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("ids").type),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        step = self.length * PAGE
        whole = len(self.rest) // step * step
        for at in range(0, whole, step):
            self._page(self.rest[at:at + step], step)
        self.rest = self.rest[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._page(self.rest, len(self.rest))
        self.writer.close()


def write(docs: DataFrame, path: str, out: str | None = None, end: int = 2, length: int = LENGTH) -> DataFrame:
    """Write the files and return their manifest: ``part, path, n_docs, n_tokens, start`` (tokens in all files before)."""
    spark = docs.sparkSession
    out = (out or folder(spark, "sequences")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, n_docs = TaskContext.get().partitionId(), 0, 0
        fs, base = place(out)
        name, attempt = posixpath.join(base, f"part-{task:06d}"), uuid.uuid4().hex
        pages = index = None
        for batch in (part for whole in batches for part in slices(whole)):
            ids, counts = encoded(pc.fill_null(batch.column(1), ""), path, memory(path))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end)  # the end id behind each document
            counts = counts + 1
            if pages is None:
                fs.create_dir(base, recursive=True)
                files = [fs.open_output_stream(f"{name}.{kind}.{attempt}") for kind in ("ids", "docs")]
                pages = Pages(files[0], layout(tokenizer(path).get_vocab_size(), length), length)
                index = pa.ipc.new_file(files[1], INDEX)
            pages.add(ids)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + np.cumsum(counts) - counts), pa.array(counts)], schema=INDEX))
            at, n_docs = at + len(ids), n_docs + len(counts)
        if pages is not None:
            pages.close()
            index.close()
            for file, kind in zip(files, ("ids", "docs")):
                file.close()
                fs.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": [task], "path": [f"{out}/part-{task:06d}"], "n_docs": [n_docs], "n_tokens": [at]},
                                             schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id"))
    rows = stored(dealt.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def sequence(uri: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a file; of a local file the ids are a view of the mapped bytes."""
    fs, path = place(uri + ".ids")
    source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(k // PAGE)
    ids, mask = batch.column(0)[k % PAGE].values, batch.column(1)[k % PAGE].values
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read(manifest: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` from the written files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            fs, base = place(row["path"])
            with fs.open_input_file(base + ".ids") as one, fs.open_input_file(base + ".docs") as two:
                ids, docs = pa.ipc.open_file(one), pa.ipc.open_file(two)
                page, held, first = 0, np.empty(0, np.uint32), 0  # held: ids from position ``first`` on
                for k in range(docs.num_record_batches):
                    part = docs.get_batch(k)
                    sums = []
                    for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        crc, at = 0, start
                        while at < start + n:
                            if at >= first + len(held):
                                first += len(held)
                                batch = ids.get_batch(page)
                                values = batch.column(0).values.to_numpy()
                                held = values[batch.column(1).values.to_numpy(zero_copy_only=False)].astype("<u4")
                                page += 1
                                continue
                            piece = held[at - first:start + n - first]
                            crc = zlib.crc32(piece.tobytes(), crc)
                            at += len(piece)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pc.add(part.column(1), row["start"]), part.column(2), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "path", "start").repartition(n, "part").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
