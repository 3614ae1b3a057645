"""Operator 6, benchmark decontamination: spaced-seed hashing with substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import chunks, documents_of, mix, read_table, signed, stage, words_of
from tarnstone.llm.repeats import NO_ID, ids_of, keyed, unkeyed

#: A passage counts as leaked if WINDOW words in a row stand in a document with at most WRONG of them replaced.
WINDOW = 13
WRONG = 2
#: Shorter items are matched whole, and those under this many words not at all.
LEAST_WORDS = 5
#: Bits of the table of item hashes that every task gets; more items fill it more, which lets more hashes through to the join.
FILTER_BITS = 22
#: Seeds of items up to which the table of them is broadcast; a larger one is shuffled, with the documents' seeds.
BROADCAST_SEEDS = 200_000


def seeds(window: int = WINDOW, wrong: int = WRONG) -> list[tuple[int, ...]]:
    """Fixed masks: the window falls into wrong + 2 blocks, and a mask keeps two of them.

    wrong replaced words touch as many blocks at most, so two blocks stay whole and one of the masks sees no change.
    """
    edges = [round(i * window / (wrong + 2)) for i in range(wrong + 3)]
    blocks = [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [tuple(p for b in kept for p in b) for kept in combinations(blocks, 2)]


def _seed_hashes(words: np.ndarray, mask: tuple[int, ...], window: int, which: int) -> np.ndarray:
    """A hash of the kept positions for each window start."""
    n = max(0, len(words) - window + 1)
    h = np.full(n, which + 1, np.uint64)
    for p in mask:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[p : p + n]
    return mix(h)


def _item_seeds(window: int, wrong: int, least: int):
    """Rows (item_id, n_words, mask, h, at, words): a seed of an item, where its window starts, and the window's word numbers."""
    masks = [(m, mask, window, m) for m, mask in enumerate(seeds(window, wrong))]
    masks += [(-n, tuple(range(n)), n, 100 + n) for n in range(least, window)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            _, _, h, first = words_of(data, offsets, lower=True)
            ids, n_words = ids_of(rows), np.diff(first)
            for m, mask, size, which in masks:
                # Long items have every mask at every start, short ones their own mask once.
                row = np.flatnonzero(n_words >= window if m >= 0 else n_words == size)
                starts = n_words[row] - size + 1
                row = np.repeat(row, starts)
                at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
                place = first[row] + at
                if not len(row):
                    continue
                x = _seed_hashes(h, mask, size, which)[place]
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * size), pa.array(signed(h[(place[:, None] + np.arange(size)).ravel()])))
                columns = [pa.array(ids[row]), pa.array(n_words[row].astype(np.int32)), pa.array(np.full(len(row), m, np.int32)), pa.array(signed(x)), pa.array(at.astype(np.int32)), words]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "n_words", "mask", "h", "at", "words"])

    return listed


def _document_seeds(window: int, wrong: int, packed: bytes, short: list[int], bits: int):
    """Rows (doc_id, mask, h, at, words) for seeds whose hash the table knows: the words about the seed go along."""
    masks = [(m, mask, window, m) for m, mask in enumerate(seeds(window, wrong))]
    masks += [(-n, tuple(range(n)), n, 100 + n) for n in short]
    top = np.uint64(64 - bits)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for rows, data, offsets in chunks(batches):
            _, _, h, first = words_of(data, offsets, lower=True)
            ids = ids_of(rows)
            for m, mask, size, which in masks:
                x = _seed_hashes(h, mask, size, which)
                at = np.flatnonzero(table[(x >> top).astype(np.int64)]) if len(x) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, at, "right") - 1
                fits = at + size <= first[np.minimum(doc + 1, len(first) - 1)]
                at, doc = at[fits], doc[fits]
                if not len(at):
                    continue
                # A mask starts where its window does: the words of that window are all that verification needs.
                take = (at[:, None] + np.arange(size)).ravel()
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(signed(h[take])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(np.full(len(at), m, np.int32)), pa.array(signed(x[at])), pa.array((at - first[doc]).astype(np.int32)), words], ["doc_id", "mask", "h", "at", "words"]
                )

    return listed


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, wrong: int = WRONG, least: int = LEAST_WORDS, bits: int = FILTER_BITS, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it leaks: doc_id, item_id, n_words, n_windows, n_matched, first_word.

    Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case. A document leaks an item if some window words in a row of the item
    stand in it, word by word at one place, with at most wrong of them replaced; an item shorter than a window, of at
    least `least` words, if it stands in it whole. n_windows counts the item's windows that were found, n_matched the item's
    words under them, first_word is the first place in the document. Any such window keeps two blocks of words whole, so
    one of the fixed masks hashes it alike on both sides; the hashes are joined in Spark and the words compared.

    Null or empty texts leak nothing and are leaked by nothing; repeated rows (one id, one text) count once; rows without
    an id are reported together under a null id; texts that share an item's id count as one item; very long texts and items take memory in proportion; an empty table on either side gives an empty result; other
    columns are not looked at.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    item = stage(items.mapInArrow(_item_seeds(window, wrong, least), "item_id long, n_words int, mask int, h long, at int, words array<long>"), "leak-items")
    # The driver gets one bit field of fixed size and the short lengths, never the hashes themselves.
    slots = item.select(F.shiftrightunsigned("h", 64 - bits).alias("slot")).distinct()
    packed = slots.groupBy(F.expr(f"slot >> {max(0, bits - 10)}").alias("block")).agg(F.collect_list("slot").alias("slots"))
    table = np.zeros(1 << bits, bool)
    for r in packed.toLocalIterator():
        table[np.array(r["slots"], np.int64)] = True
    short = sorted(-r["mask"] for r in item.filter("mask < 0").select("mask").distinct().collect())
    seed = keyed(documents_of(docs, text_col, id_col)).mapInArrow(_document_seeds(window, wrong, np.packbits(table).tobytes(), short, bits), "doc_id long, mask int, h long, at int, words array<long>")
    item = F.broadcast(item) if item.count() <= BROADCAST_SEEDS else item
    near = seed.withColumnRenamed("at", "place").withColumnRenamed("words", "found").join(item, ["mask", "h"])
    size = F.size("found")
    same = F.size(F.filter(F.zip_with("found", "words", lambda x, y: x == y), lambda x: x))
    hit = near.filter(same >= size - F.when(F.col("mask") < 0, 0).otherwise(wrong))
    hit = hit.groupBy("doc_id", "item_id", "at").agg(F.max("n_words").alias("n_words"), F.min("place").alias("place"), F.max(size).alias("size"))
    out = hit.groupBy("doc_id", "item_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_windows"), F.min("place").cast("long").alias("first_word"), F.sort_array(F.collect_list("at")).alias("ats"), F.first("size").alias("size")
    )
    cover = F.aggregate("ats", F.struct(F.lit(0).alias("c"), F.lit(0).alias("e")), lambda a, p: F.struct((a["c"] + p + F.col("size") - F.greatest(a["e"], p)).alias("c"), (p + F.col("size")).alias("e")), lambda a: a["c"])
    out = out.select("doc_id", F.when(F.col("item_id") != NO_ID, F.col("item_id")).alias("item_id"), "n_words", "n_windows", cover.cast("long").alias("n_matched"), "first_word")
    return unkeyed(out)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that leak an item; all columns as they are. Texts are judged one by one, also where several share an
    id or have none."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")))
    packed = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    bad = contaminated(packed, benchmark, id_col="key", **options).select(F.col("doc_id").alias("key")).distinct()
    return packed.join(bad, "key", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
