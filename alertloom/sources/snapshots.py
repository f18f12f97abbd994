"""Generations of snapshots: committed by their manifest, refused when torn, expired when no reader holds them.

A generation is a folder ``gen=<stamp>`` below a path. Its manifest is written last and names rows and checksum of every
table; what has no finished manifest, or tables that differ from it, is torn. Readers leave a lease beside the
generations, a file whose name ends with the time until which it holds, so that expiry passes over what they read. Files are
touched through the file system of the path, whichever Hadoop knows for it.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from alertloom.sources.tables import verify_snapshot


class TornSnapshot(ValueError):
    """The generation is unfinished or differs from its manifest."""


@dataclass(frozen=True)
class Generation:
    stamp: str
    committed: bool
    leased: bool


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, found = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found)


def generations(spark: SparkSession, path: str, now: float | None = None) -> list[Generation]:
    """All generations below a path, oldest stamp first: one folder per run, so a short list."""
    now = time.time() if now is None else now
    out = []
    for name in _names(spark, path):
        if name.startswith("gen="):
            held = any(float(lease.rpartition("-")[2]) > now for lease in _names(spark, f"{path}/_leases/{name}"))
            out.append(Generation(name[4:], _exists(spark, f"{path}/{name}/_manifest/_SUCCESS"), held))
    return out


def read_snapshot(spark: SparkSession, path: str, stamp: str | None = None) -> dict[str, DataFrame]:
    """The tables of a generation, by default the newest that is committed, once they agree with the manifest."""
    known = {g.stamp: g for g in generations(spark, path)}
    wanted = stamp or max((s for s, g in known.items() if g.committed), default=None)
    if wanted not in known or not known[wanted].committed:
        raise TornSnapshot(f"no finished generation {wanted or ''} below {path}")
    base = f"{path}/gen={wanted}"
    names = [r["name"] for r in spark.read.parquet(f"{base}/_manifest").select("name").collect()]  # one row per table
    missing = [n for n in names if not _exists(spark, f"{base}/{n}/_SUCCESS")]
    if missing:
        raise TornSnapshot(f"{base}: missing {', '.join(missing)}")
    differing = [r["name"] for r in verify_snapshot(spark, base).select("name").collect()]
    if differing:
        raise TornSnapshot(f"{base}: other rows than the manifest says in {', '.join(sorted(differing))}")
    return {name: spark.read.parquet(f"{base}/{name}") for name in names}


@contextmanager
def reading(spark: SparkSession, path: str, stamp: str, seconds: float = 3600, now: float | None = None) -> Iterator[None]:
    """Hold a generation while the block runs, for ``seconds`` at most: a reader that dies holds it no longer."""
    until = (time.time() if now is None else now) + seconds
    fs, lease = _path(spark, f"{path}/_leases/gen={stamp}/{uuid.uuid4().hex}-{until}")
    fs.create(lease).close()
    try:
        yield
    finally:
        fs.delete(lease, False)


def expire(spark: SparkSession, path: str, keep: int, now: float | None = None) -> list[str]:
    """Delete all but the newest ``keep`` committed generations, and torn ones older than the newest committed one, unless they
    are leased; returns the stamps that went. The manifest goes first, so that what is half deleted counts as torn."""
    if keep < 1:
        raise ValueError("one generation must stay")
    found = generations(spark, path, now)
    stay = sorted((g.stamp for g in found if g.committed), reverse=True)[:keep]
    gone = []
    for g in found:
        if g.stamp not in stay and not g.leased and stay and g.stamp < stay[0]:
            fs, manifest = _path(spark, f"{path}/gen={g.stamp}/_manifest")
            fs.delete(manifest, True)
            fs.delete(_path(spark, f"{path}/gen={g.stamp}")[1], True)
            gone.append(g.stamp)
    return gone
