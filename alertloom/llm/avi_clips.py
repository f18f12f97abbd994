"""Media columns as AVI with motion JPEG of the lossless process (ITU T.81, Annex H).

A payload becomes frames of 16 x 12 8-bit samples. Each frame is a JPEG of its own (SOF3, predictor 1). The Huffman table
gives category c a code of 9 - c bits, so every sample takes nine bits with its magnitude bits and both directions are array
operations. The reader walks the RIFF chunks, takes the frames from the ``idx1`` index, decodes them and finds shots where the
histogram difference of neighbouring frames stands out from the differences before it.

Defined cases: a null or empty text is one frame of spaces; equal texts give equal bytes; a broken file raises an error.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bpe_prefix import slices

WIDTH, HEIGHT = 16, 12
SAMPLES = WIDTH * HEIGHT
FRAME_MS = 40
BINS = 16
WINDOW = 8
JUMP = 120

_d = np.arange(-255, 256)
_c = np.ceil(np.log2(np.abs(_d) + 1)).astype(int)
CODE = (((1 << (9 - _c)) - 2 << _c) + np.where(_d > 0, _d, _d + (1 << _c) - 1)).astype(np.uint16)
DIFF = np.full(512, 1 << 14, np.int16)
DIFF[CODE] = _d

TABLE = b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
SIZE = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
SCAN = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
HEAD = b"\xff\xd8" + TABLE + SIZE + SCAN
TAIL = b"\xff\xd9"


def pack(codes: np.ndarray) -> np.ndarray:
    """Nine-bit codes, eight in nine bytes."""
    c = codes.reshape(-1, 8).astype(np.uint16)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] & ((1 << k) - 1)) << (8 - k) | c[:, k] >> (k + 1)
    out[:, 8] = c[:, 7] & 255
    return out


def unpack(data: np.ndarray) -> np.ndarray:
    b = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        out[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 511
    return out


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One JPEG for each row of ``SAMPLES`` samples."""
    a = samples.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = np.empty_like(a)
    d[:, :, 1:] = a[:, :, 1:] - a[:, :, :-1]
    d[:, 1:, 0] = a[:, 1:, 0] - a[:, :-1, 0]
    d[:, 0, 0] = a[:, 0, 0] - 128
    coded = pack(CODE[d + 255]).tobytes()
    step = SAMPLES * 9 // 8
    return [HEAD + coded[at:at + step].replace(b"\xff", b"\xff\x00") + TAIL for at in range(0, len(coded), step)]


def scan_of(jpeg: bytes) -> bytes:
    """The entropy-coded bytes of a frame, after its segments are checked."""
    if jpeg.startswith(HEAD):
        at = len(HEAD)
    else:
        at, seen = 2, {}
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        while jpeg[at + 1:at + 2] != b"\xda":
            size = struct.unpack_from(">H", jpeg, at + 2)[0]
            seen[jpeg[at + 1]] = jpeg[at:at + 2 + size]
            at += 2 + size
        if seen.get(0xC3) != SIZE or seen.get(0xC4) != TABLE or not jpeg[at:].startswith(SCAN):
            raise ValueError("a JPEG process, size or table that is not read here")
        at += len(SCAN)
    if jpeg[-2:] != TAIL:
        raise ValueError("a truncated JPEG frame")
    return jpeg[at:-2].replace(b"\xff\x00", b"\xff")


def decode_frames(frames: list[bytes]) -> np.ndarray:
    scans = b"".join(map(scan_of, frames))
    if len(scans) != len(frames) * SAMPLES * 9 // 8:
        raise ValueError("a frame of another length")
    d = DIFF[unpack(np.frombuffer(scans, np.uint8))].reshape(-1, HEIGHT, WIDTH)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16) + 128
    a = np.cumsum(d, axis=2, dtype=np.int16)
    if a.size and (a.min() < 0 or a.max() > 255):
        raise ValueError("a sample out of range")
    return a.astype(np.uint8).reshape(-1, SAMPLES)


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF file of one video stream with its ``idx1`` index."""
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", FRAME_MS * 1000, most * 1000 // FRAME_MS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    sizes = np.fromiter(map(len, frames), np.int64, n)
    ends = np.cumsum(8 + sizes + (sizes & 1))
    index = np.empty((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + ends - (8 + sizes + (sizes & 1))
    index[:, 3] = sizes
    movi = b"movi" + b"".join([chunk(b"00dc", f) for f in frames])
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds per frame and the frames, by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, stop, parts = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]), {}
    while at + 8 <= stop:
        kind, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        parts[data[at + 8:at + 12] if kind == b"LIST" else kind] = (at + 8, size)
        at += 8 + size + (size & 1)
    if not {b"hdrl", b"movi", b"idx1"} <= parts.keys():
        raise ValueError("an AVI file without header, frames or index")
    begin, size = parts[b"idx1"]
    index = np.frombuffer(data, "<u4", size // 16 * 4, begin).reshape(-1, 4)
    base = parts[b"movi"][0]
    own = index[:, 0] == int.from_bytes(b"00dc", "little")
    spans = zip((base + 8 + index[own, 2].astype(np.int64)).tolist(), index[own, 3].tolist())
    return struct.unpack_from("<I", data, parts[b"hdrl"][0] + 12)[0], [data[a:a + n] for a, n in spans]


def cuts(samples: np.ndarray) -> np.ndarray:
    """Frames that begin a shot: the histogram difference is at least ``JUMP`` and one and a half times the mean of up to
    ``WINDOW`` differences before it, in integers."""
    n = len(samples)
    marks = np.arange(n)[:, None] * BINS + (samples >> 4)
    hist = np.bincount(marks.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    total = np.concatenate([[0], np.cumsum(diff)])
    k = np.arange(len(diff))
    low = np.maximum(k - WINDOW, 0)
    before, m = total[k] - total[low], k - low
    return np.nonzero((diff >= JUMP) & ((m == 0) | (2 * diff * m >= 3 * before)))[0] + 1


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % SAMPLES or (SAMPLES if not text else 0))


def media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as one AVI file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            padded = [payload(t) for t in texts]
            frames, at, files = encode_frames(np.frombuffer(b"".join(padded), np.uint8)), 0, []
            for p in padded:
                n = len(p) // SAMPLES
                files.append(write_avi(frames[at:at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())],
                                             names=["doc_id", "n_bytes", "media"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(files: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload length and digests, digest of the file, and the shots as a feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                samples = decode_frames(read_avi(data)[1])
                body = samples.tobytes()
                found = cuts(samples)
                rows.append((doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                             f"frames={len(samples)};shots={len(found) + 1};cuts={','.join(map(str, found.tolist()))}"))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[
                    "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
    return files.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string")


def clips(files: DataFrame) -> DataFrame:
    """Timed clip rows ``doc_id, clip, first_frame, n_frames, start_ms, end_ms``, one per shot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                micros, frames = read_avi(data)
                starts = np.concatenate([[0], cuts(decode_frames(frames))]).astype(np.int64)
                ends = np.append(starts[1:], len(frames))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(starts), pa.int64()), pa.array(np.arange(len(starts)), pa.int64()), pa.array(starts),
                     pa.array(ends - starts), pa.array(starts * micros // 1000), pa.array(ends * micros // 1000)],
                    names=["doc_id", "clip", "first_frame", "n_frames", "start_ms", "end_ms"])
    return files.select("doc_id", "media").mapInArrow(
        run, "doc_id long, clip long, first_frame long, n_frames long, start_ms long, end_ms long")
