"""Shared helpers: staged tables in the cluster's shared folder, Arrow chunking and numpy hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass holds at once; one longer document is handled alone.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session on one machine (tests) gets a temporary one; a cluster
    has no folder that all its machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    A lost executor then costs only the tasks that read this table. Shuffle files of the finished job are
    released as soon as the driver has collected its garbage, which is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnstone/{name}-{uuid.uuid4().hex}"
    # Zstandard gives its buffers back at once; the default codec leaves them outside the heap until a collection.
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def documents_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) with a null text as empty; every other column is left behind, so names cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---------------------------------------------------------------- Arrow chunks

def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yields (rows, bytes, offsets): consecutive rows of at most about limit bytes of UTF-8, and where each row starts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if len(col) == 0:
            continue
        large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        _, offs, data = col.buffers()
        width = np.int64 if large else np.int32
        offsets = np.frombuffer(offs, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2^64, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        base = _BASES[which]
        size = max(n, CHUNK_BYTES) + 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:
            _POWERS[which] = have
    return have


def prefix_sums(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """S with S[j] - S[i] = sum of codes[t] * base^t over i <= t < j: the polynomial hash of any slice in two lookups."""
    p, _ = powers(len(codes), which)
    s = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], out=s[1:])
    return s


def slice_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of slices, the same wherever a slice stands."""
    _, q = powers(len(s), which)
    return mix((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first): words [^\\x20\\x09-\\x0D]+ of concatenated documents, and each document's first word."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[:-1] = space[1:]
    inner = offsets[offsets < n]
    before[inner] = True
    after[offsets[offsets > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    h = slice_hash(prefix_sums(BYTE_CODES[data]), start, end)
    return start, end, h, np.searchsorted(start, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(x) - w + 1], m[w - have : w - have + len(x) - w + 1])
    return m
