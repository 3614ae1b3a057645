"""Operator 8, substring dedup: Rabin-Karp hashes of word windows, counted in Spark, merged into maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import chunks, documents_of, prefix_sums, read_table, signed, slice_hash, stage, unstage, words_of
from tarnstone.llm.repeats import DOC, Windows, covered, ids_of, keyed, per_row, repeated_segments, runs_of, settle, shared_ids, told_apart, unkeyed, with_runs

WINDOW = 20
GRAM = 5


def removal_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Staged (doc_id, sub, start, nwin): runs of window starts, in words, whose window also starts earlier in the corpus.

    docs: doc_id, sub, text. Equal segments are counted by a Rabin-Karp hash of all their words, which their windows share;
    where segments differ, the hash of each window is counted.
    """
    windows = Windows("word", window, min(gram, window - 1))
    segments = repeated_segments(docs, windows, "words")
    runs, left, firsts = settle(segments, "words")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            codes, first = windows.codes(data, offsets)
            row, start, nwin = runs_of(rows, first, 0, 1)
            begin = np.repeat(start, nwin) + np.arange(nwin.sum()) - np.repeat(np.cumsum(nwin) - nwin, nwin)
            row = np.repeat(row, nwin)
            keep = begin + window <= first[row + 1]
            begin, row = begin[keep], row[keep]
            h = [signed(slice_hash(prefix_sums(codes, k), begin, begin + window, k)) for k in (0, 1)]
            columns = [*h, ids_of(rows)[row], ids_of(rows, "sub")[row], (begin - first[row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc_id", "sub", "start"])

    each = stage(with_runs(docs, left, how="inner").mapInArrow(hashed, "h1 long, h2 long, doc_id long, sub long, start int"), "words-windows")
    counted = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*DOC, "start")).alias("first")).filter("n > 1")
    later = each.join(counted, ["h1", "h2"]).filter(F.struct(*DOC, "start") != F.col("first"))
    found = stage(runs.unionByName(later.select(*DOC, "start", F.lit(1).alias("nwin"))), "words-runs")
    unstage(segments, firsts, each)
    return found


def dedup_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_col: str = "text", id_col: str = "doc_id", digest: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, and kept_sha256, or with digest=False kept_text (kept words, one space between).

    A word goes if it lies under a window of words that also starts earlier: in a smaller doc_id, or in the same document
    at an earlier word. Windows are judged on the input, so the order of removal does not matter. A null or empty text has
    no words; a text shorter than a window keeps all; repeated rows (one id, one text) share their decision; different
    texts of one id are documents of their own, in the order of their hashes; rows without an id come before all others;
    other columns are not looked at; very long texts are handled whole, one at a time; an empty table gives an empty one.
    """
    docs = keyed(documents_of(docs, text_col, id_col))
    docs = told_apart(docs, shared_ids(docs, "words"))
    last = "kept_sha256" if digest else "kept_text"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            start, end, _, first = words_of(data, offsets)
            row, run, nwin = runs_of(rows, first, 0, 1)
            gone = covered(len(start), first, row, run, nwin, window)
            stay = ~gone
            s, size = start[stay], (end - start)[stay] + 1
            to = np.cumsum(size)
            body = np.append(data, np.uint8(32))[np.repeat(s - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
            body[to - 1] = 32
            raw, ends = body.tobytes(), np.append(0, to)[np.append(0, np.cumsum(per_row(stay, first)))]
            texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            texts = [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in texts]
            columns = [pa.array(ids_of(rows)), pa.array(np.diff(first)), pa.array(per_row(gone, first)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", last])

    joined = with_runs(docs, removal_runs(docs, window, gram))
    return unkeyed(joined.mapInArrow(kept, f"doc_id long, n_words long, n_removed long, {last} string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(read_table(spark, sf_dir, "documents"))
