"""What the operators share: tables in the shared folder, shipping of this package, hashing of word runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: White space as the contracts define it: bytes 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are part of a word once punctuation is dropped: ASCII letters and digits, and all of a multi-byte character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POS = np.random.default_rng(20240229).integers(0, 2**63, 1 << 12, dtype=np.uint64) | U64(1)
_CASED = np.random.default_rng(7).integers(0, 2**63, 1 << 12, dtype=np.uint64) | U64(1)


# ---------------------------------------------------------------- tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.environ.get("PARLANCE_SCRATCH")
        if not found:
            found = os.environ["PARLANCE_SCRATCH"] = tempfile.mkdtemp(prefix="parlance-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


#: Whether Spark removes the files of a query's shuffles as soon as it is done.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: dict[str, SparkSession] = {}


def write(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; its shuffles' files go at once, not when the driver's garbage collector notices."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df once into the shared folder and reads it back: the lineage ends there and survives lost executors.

    The table stays until drop(), or until this process ends: what an operator returns still reads some of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _left:
        atexit.register(_sweep)
    _left[path] = spark
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables made by save() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._scratch)
        _left.pop(t._scratch, None)


def _sweep() -> None:
    """At this process's end: removes the tables that are left of sessions that still run."""
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they can import it by name."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="parlance-")) / "parlance.zip"
    atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def plain(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 and so on: none can clash with those that an operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))


_caches: dict[str, Callable[[], None]] = {}


def hold(name: str = "", clear: Callable[[], None] | None = None) -> None:
    """Called where a task begins: frees what other operators' tasks have left in this worker process, and notes how to free its own."""
    for other in [k for k in _caches if k != name]:
        _caches.pop(other)()
    if clear:
        _caches[name] = clear


# ---------------------------------------------------------------- Arrow batches


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary or string column, without copying a value; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return d, o - (o[0] if len(o) else 0)


def slices(offs: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, so that numpy's temporary arrays stay small; one row may be larger."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows: what Python makes of a piece is freed before the next."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words_of(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of every word: a longest run of bytes for which `word` holds, within one row."""
    inside = word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, ASCII letters in lower case."""
    if not len(starts):
        return np.zeros(0, U64)
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    at = np.flatnonzero(np.cumsum(keep[:-1]))
    lens = ends - starts
    base = np.cumsum(lens) - lens
    pos = np.arange(len(at)) - np.repeat(base, lens)
    v = (LOWER[data[at]].astype(U64) + U64(1)) * _POS[pos & 4095]
    v ^= (pos >> 12).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix(np.add.reduceat(v, base) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of spans that don't overlap and aren't empty, case kept."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    base = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(base, lens)
    v = (data[np.repeat(starts, lens) + pos].astype(U64) + U64(1)) * _CASED[pos & 4095]
    v ^= (pos >> 12).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix(np.add.reduceat(v, base) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 values mean nothing. Made by doubling."""
    a, out, done, cur, size = U64(0xD6E8FEB86659FD93), None, 0, h, 1
    n = len(h)
    while size <= k:
        if k & size:
            if out is None:
                out = cur.copy()
            else:
                nxt = np.zeros(n, U64)
                nxt[: max(n - done, 0)] = cur[done:]
                out = mix(out * a + nxt)
            done += size
        if size * 2 <= k:
            nxt = np.zeros(n, U64)
            nxt[: max(n - size, 0)] = cur[size:]
            cur = mix(cur * a + nxt + U64(size))
        size *= 2
    return out
