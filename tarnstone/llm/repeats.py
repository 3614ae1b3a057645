"""Repeated windows of a fixed length in a corpus of sequences (bytes or words).

Every window is filed under its minimizer, the least hash of the short grams inside it. Equal windows have equal
minimizers, so they always meet in the same family. A segment is a run of consecutive window starts of one document with
one minimizer. Segments whose minimizer occurs once hold no repeated window and go first; equal segments are then settled
as a whole, and only the distinct segments of a family remain to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.llm.common import BYTE_CODES, chunks, column, prefix_sums, signed, sliding_min, slice_hash, stage, unstage, words_of

#: Bytes of text that are cut into segments at once; each takes about a hundred bytes of a worker's memory meanwhile.
SEGMENT_BYTES = 1 << 18
#: Ids that several texts share, up to which they are broadcast.
BROADCAST_IDS = 200_000
NO_ID = -(1 << 63)
#: What tells a document from others: its id, and its text's hash where several texts share the id (else 0).
DOC = ("doc_id", "sub")
SEGMENT = "doc_id long, sub long, start int, nwin int, mhash long, s1 long, s2 long, inner boolean"


@dataclass(frozen=True)
class Windows:
    """unit: byte or word; length: of a window; gram: of the grams that minimizers are taken from (gram < length)."""

    unit: str
    length: int
    gram: int

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for each unit of concatenated documents, and where each document starts."""
        if self.unit == "byte":
            return BYTE_CODES[data], offsets
        _, _, h, first = words_of(data, offsets)
        return h, first

    def segments(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(prefix sums, document, start, windows, minimizer, inner) of all segments; starts count from the first document.

        inner: the segment may hold a window twice. Then the least gram stands at the left edge of one of its windows and,
        further right, at the right edge of one.
        """
        n, w = len(codes), self.length
        none = np.zeros(0, np.int64)
        sums = prefix_sums(codes)
        if n < w:
            return sums, none, none, none, np.zeros(0, np.uint64), none.astype(bool)
        at = np.arange(n - self.gram + 1)
        grams, reach = slice_hash(sums, at, at + self.gram), w - self.gram
        least = sliding_min(grams, reach + 1)
        have = np.maximum(0, first[1:] - first[:-1] - w + 1)
        rows = np.flatnonzero(have)
        begin = first[:-1][rows]
        step = np.zeros(len(least) + 1, np.int8)
        step[begin] += 1
        step[begin + have[rows]] -= 1
        breaks = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=breaks[1:])
        breaks[begin] = True
        valid = np.cumsum(step[:-1], dtype=np.int8) > 0
        breaks &= valid
        start = np.flatnonzero(breaks)
        if len(start) == 0:
            return sums, none, none, none, np.zeros(0, np.uint64), none.astype(bool)
        here = at[: len(least)]
        left = np.minimum.reduceat(np.where(valid & (grams[: len(least)] == least), here, n), start)
        right = np.maximum.reduceat(np.where(valid & (grams[reach:] == least), here + reach, -1), start)
        doc = rows[np.searchsorted(begin, start, "right") - 1]
        end = np.minimum(np.append(start[1:], n), first[doc] + have[doc])
        return sums, doc, start, end - start, least[start], left < right


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with rows that lack an id filed together under the least number."""
    return docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def shared_ids(docs: DataFrame, name: str) -> DataFrame | None:
    """The ids of keyed documents that several texts share, broadcast if they are counted to be few; None if there are none."""
    hashed = F.xxhash64("text")
    ids = docs.select("doc_id", hashed.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    shared = stage(ids.filter("a != b").select("doc_id", F.lit(True).alias("shared")), f"{name}-shared")
    n = shared.count()
    if n == 0:
        unstage(shared)
        return None
    return F.broadcast(shared) if n <= BROADCAST_IDS else shared


def told_apart(docs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """(doc_id, sub, text): keyed documents, with different texts of one of the shared ids told apart, in the order of their hashes.

    Rows that repeat an id and its text stay one document.
    """
    if shared is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("sub"), "text")
    joined = docs.join(shared, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("shared"), F.xxhash64("text")).otherwise(0).alias("sub"), "text")


def unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def repeated_segments(docs: DataFrame, windows: Windows, name: str) -> DataFrame:
    """Staged segments whose minimizer occurs at least twice in the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, data, offsets in chunks(iter([batch]), limit=SEGMENT_BYTES):
                _, _, _, _, least, inner = windows.segments(*windows.codes(data, offsets))
                found += [least, least[inner]]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["mhash", "n"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, limit=SEGMENT_BYTES):
            codes, first = windows.codes(data, offsets)
            sums, doc, start, nwin, least, inner = windows.segments(codes, first)
            end = start + nwin + windows.length - 1
            second = prefix_sums(codes, 1)
            columns = [ids_of(rows)[doc], ids_of(rows, "sub")[doc], (start - first[doc]).astype(np.int32), nwin.astype(np.int32), signed(least), signed(slice_hash(sums, start, end)), signed(slice_hash(second, start, end, 1)), inner]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "sub", "start", "nwin", "mhash", "s1", "s2", "inner"])

    often = docs.mapInArrow(counted, "mhash long, n long").groupBy("mhash").agg(F.sum("n").alias("n")).filter("n >= 2").select("mhash")
    return stage(docs.mapInArrow(listed, SEGMENT).join(often, "mhash").select(*DOC, "start", "nwin", "mhash", "s1", "s2", "inner"), f"{name}-segments")


def settle(segments: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, open, firsts): window runs that repeat a whole earlier segment, and the first copies of segments still to be compared.

    Copies of a segment, by 128 bits of hash and its length, are counted as one. runs: doc_id, sub, start, nwin. open: mhash,
    doc_id, sub, start, nwin, of families with two distinct segments, or with one that may hold a window twice. firsts: the
    staged table both read.
    """
    key = ["mhash", "s1", "s2", "nwin"]
    firsts = stage(segments.groupBy(*key).agg(F.min(F.struct(*DOC, "start")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("inner").alias("inner")), f"{name}-firsts")
    runs = segments.join(firsts.filter("copies > 1"), key).filter(F.struct(*DOC, "start") != F.col("first")).select(*DOC, "start", "nwin")
    several = firsts.groupBy("mhash").agg(F.count(F.lit(1)).alias("kinds"), F.max("inner").alias("inner")).filter("kinds > 1 OR inner").select("mhash")
    left = firsts.join(several, "mhash").select("mhash", "first.*", "nwin")
    return runs, left, firsts


def with_runs(docs: DataFrame, runs: DataFrame, extra: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """docs with the column runs: array of (start, nwin, *extra), empty where there are none. A list is bounded by its document."""
    listed = runs.groupBy(*DOC).agg(F.collect_list(F.struct("start", "nwin", *extra)).alias("runs"))
    joined = docs.join(listed, list(DOC), how)
    empty = F.array().cast(dict(listed.dtypes)["runs"])
    return joined.select(*DOC, "text", F.coalesce("runs", empty).alias("runs"))


def runs_of(rows: pa.RecordBatch, first: np.ndarray, *fields: int) -> list[np.ndarray]:
    """(row of each run, start counted from the first row, ...): the flattened runs column."""
    lists = column(rows, "runs")
    offs = lists.offsets.to_numpy()
    values = lists.values.slice(offs[0], offs[-1] - offs[0])
    row = np.repeat(np.arange(len(lists)), np.diff(offs))
    out = [np.asarray(values.field(i)) for i in fields]
    return [row, out[0].astype(np.int64) + first[row], *[x.astype(np.int64) for x in out[1:]]]


def covered(n: int, first: np.ndarray, row: np.ndarray, start: np.ndarray, nwin: np.ndarray, length: int) -> np.ndarray:
    """Which units lie under a window of the runs; a run never leaves its document."""
    stop = first[row + 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(start, stop), 1)
    np.add.at(step, np.minimum(start + nwin + length - 1, stop), -1)
    return np.cumsum(step[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    s = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=s[1:])
    return s[first[1:]] - s[first[:-1]]

