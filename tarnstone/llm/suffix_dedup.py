"""Operator 3, suffix-array dedup: per-shard suffix arrays, Kasai common prefixes, cross-shard merging by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import BYTE_CODES, chunks, documents_of, prefix_sums, read_table, slice_hash, stage, unstage
from tarnstone.llm.repeats import DOC, Windows, covered, ids_of, keyed, per_row, repeated_segments, runs_of, settle, shared_ids, told_apart, unkeyed, with_runs

LENGTH = 100
GRAM = 20
#: Bytes of segments in a shard. A family above it is dealt to several shards, whose results are merged.
SHARD_BYTES = 1 << 20


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros behind the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(wide, (len(text), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(text: np.ndarray, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) by Larsson-Sadakane refinement.

    Suffixes are ordered by their first 8 bytes; then, for 8, 16, 32 ... bytes, only the groups that are still tied are
    ordered by the rank of the suffix that many bytes further on. With reach, suffixes that agree in so many bytes may
    stay tied, and then stand in text order.
    """
    n = len(text)
    key = _eights(text)
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    h = 8
    while len(tied) and h < (reach or n):
        sub = order[tied]
        on = sub + h
        # Behind the end, a shorter suffix goes first.
        after = np.where(on < n, rank[np.minimum(on, n - 1)] + h + 1, n - sub)
        pair = rank[sub] * np.int64(n + h + 1) + after
        by = np.argsort(pair, kind="stable")
        sub, pair = sub[by], pair[by]
        order[tied] = sub
        fresh = np.ones(len(tied), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[sub] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order, rank


def kasai(text: np.ndarray, order: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in the suffix array, in text order; with reach, lengths from
    there on count as that.

    Kasai's rule: going one byte on in the text, the common prefix is shorter by one at most; it is so exactly where the
    neighbour goes on with it and the bytes passed are equal. So only the other suffixes are measured, eight bytes at a
    time, and the rest follow by counting down. Measuring stops at twice the reach; suffixes that would follow a longer one
    and come out below the reach are measured themselves, so that no suffix costs more steps than the reach has bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    most = n if reach is None else 2 * reach
    eights, steps = _eights(text), np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)

    def measured(places: np.ndarray, most: int) -> np.ndarray:
        size = np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))
        while len(open_):
            x, y = places[open_] + size[open_], before[places[open_]] + size[open_]
            room = n - np.maximum(x, y)
            equal = 8 - np.searchsorted(steps, eights[x] ^ eights[y], side="right")
            size[open_] += np.minimum(equal, room)
            open_ = open_[(equal == 8) & (room > 8) & (size[open_] < most)]
        return size

    follows = np.zeros(n, bool)
    follows[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (text[:-1] == text[before[:-1]])
    lone = np.flatnonzero(~follows & (before >= 0))
    total = at.copy()  # of a suffix without a neighbour before it: nothing
    size = measured(lone, most)
    total[lone] += size
    source = np.maximum.accumulate(np.where(follows, 0, at))
    out = total[source] - at
    if reach is not None:
        cut = np.zeros(n, bool)
        cut[lone] = size >= most
        short = np.flatnonzero(follows & cut[source] & (out < reach))
        out[short] = measured(short, reach)
        out = np.minimum(out, reach)
    return out


def shard_repeats(doc: np.ndarray, start: np.ndarray, nwin: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, position, is first, offset in the shard) of each window of a shard's segments. doc: numbers in the documents' order.

    Segments are laid end to end. A class of equal windows is a stretch of the suffix array with common prefixes of at
    least length; suffixes that start too near the end of a segment are no windows and are passed over.
    """
    text = np.frombuffer(b"".join(parts), np.uint8)
    order, _ = suffix_array(text, length)
    common = kasai(text, order, length)[order]
    size = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(parts)), size)
    inside = np.arange(len(text)) - base[owner]
    is_window = inside < nwin[owner]
    kind = np.cumsum(common < length)
    keep = is_window[order]
    at, kind = order[keep], kind[keep]
    d, p = doc[owner[at]], start[owner[at]] + inside[at]
    by = np.lexsort((p, d, kind))
    at, kind, d, p = at[by], kind[by], d[by], p[by]
    leads = np.ones(len(at), bool)
    leads[1:] = kind[1:] != kind[:-1]
    same = np.zeros(len(at), bool)  # the same window listed twice, from overlapping segments
    lead_at = np.maximum.accumulate(np.where(leads, np.arange(len(at)), 0))
    same = (d == d[lead_at]) & (p == p[lead_at])
    return d, p, leads | same, at


def as_runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions as (doc, start, count) of consecutive runs."""
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], pos[begin], pos[last] - pos[begin] + 1 if len(begin) else begin


def removal_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Staged (doc_id, sub, start, nwin): runs of byte positions at which a string of the given length starts that also starts earlier.

    docs: doc_id, sub, text. Copies of a segment are counted as one before any text is shuffled, so that no group of copies
    gathers in a shard; what distinct segments of a family share, the suffix arrays of its shards tell.
    """
    windows = Windows("byte", length, min(gram, length - 1))
    segments = repeated_segments(docs, windows, "bytes")
    runs, left, firsts = settle(segments, "bytes")
    size = F.col("nwin") + F.lit(length - 1)
    # A segment of more windows than a shard has bytes is cut; its pieces overlap by the window's length, less one.
    pieces = F.explode(F.sequence(F.lit(0), (F.col("nwin") - 1).cast("int"), F.lit(shard_bytes)))
    left = left.withColumn("piece", pieces).withColumn("nwin", F.least(F.lit(shard_bytes), F.col("nwin") - F.col("piece")).cast("int"))
    left = stage(left.select("mhash", *DOC, (F.col("start") + F.col("piece")).cast("int").alias("start"), "nwin"), "bytes-open")
    total = left.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    large = left.groupBy("mhash").agg(F.sum(size.cast("long")).alias("size")).filter(F.col("size") > shard_bytes)
    shares = F.ceil(F.coalesce("size", F.lit(1)) / F.lit(shard_bytes)).cast("int")
    dealt = left.join(large, "mhash", "left").select(
        *DOC, "start", "nwin",
        F.when(F.col("size").isNull(), F.pmod(F.xxhash64("mhash"), F.lit(shards))).otherwise(F.col("mhash")).alias("family"),
        F.when(F.col("size").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*DOC, "start"), shares).cast("int")).alias("share"),
        shares.alias("shares"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            row, at, nwin, family, share, shares = runs_of(rows, offsets, 0, 1, 2, 3, 4)
            raw = data.tobytes()
            body = [raw[a:b] for a, b in zip(at, at + nwin + length - 1, strict=True)]
            columns = [ids_of(rows)[row], ids_of(rows, "sub")[row], (at - offsets[row]).astype(np.int32), nwin.astype(np.int32), family, share.astype(np.int32), shares.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(body, pa.binary())], ["doc_id", "sub", "start", "nwin", "family", "share", "shares", "body"])

    def numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        """A number for the document of each row, in the documents' order, and the documents by number."""
        found = pdf.groupby(list(DOC), sort=True).ngroup().to_numpy(np.int64)
        return found, pdf[list(DOC)].drop_duplicates().sort_values(list(DOC), ignore_index=True)

    def sorted_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(b) for b in pdf["body"]]
        number, known = numbered(pdf)
        doc, pos, first, at = shard_repeats(number, pdf["start"].to_numpy(np.int64), pdf["nwin"].to_numpy(np.int64), parts, length)
        d, p, n = as_runs(doc[~first], pos[~first])
        out = known.iloc[d].assign(start=p, nwin=n, family=key[0], deal=-1, words=None, docs=None, subs=None, starts=None)
        if key[1] < 0:
            return out
        # This family has other shards: its first windows, sorted, are dealt by their hashes, to be merged with theirs.
        raw = np.frombuffer(b"".join(parts), np.uint8)
        at, doc, pos = at[first], known.iloc[doc[first]], pos[first]
        deal = (slice_hash(prefix_sums(BYTE_CODES[raw]), at, at + length) % np.uint64(pdf["shares"].iloc[0])).astype(np.int64)
        rows = []
        for k in np.unique(deal):
            mine = np.flatnonzero(deal == k)
            words = raw[at[mine][:, None] + np.arange(length)].tobytes()
            ids, subs = (doc[c].to_numpy(np.int64)[mine].tobytes() for c in DOC)
            rows.append({"doc_id": 0, "sub": 0, "start": 0, "nwin": 0, "family": key[0], "deal": k, "words": words, "docs": ids, "subs": subs, "starts": pos[mine].tobytes()})
        return pd.concat([out, pd.DataFrame(rows)], ignore_index=True) if len(out) else pd.DataFrame(rows)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        """The windows of each shard, sorted, are looked up by binary search in the union of all shards of a family."""
        shards = [np.frombuffer(w, np.dtype((np.void, length))) for w in pdf["words"]]
        union = np.unique(np.concatenate(shards))
        kind = np.concatenate([np.searchsorted(union, w) for w in shards])
        columns = [np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("docs", "subs", "starts")]
        d, known = numbered(pd.DataFrame({"doc_id": columns[0], "sub": columns[1]}))
        p = columns[2]
        by = np.lexsort((p, d, kind))
        d, p, kind = d[by], p[by], kind[by]
        lead = np.ones(len(d), bool)
        lead[1:] = kind[1:] != kind[:-1]
        at = np.maximum.accumulate(np.where(lead, np.arange(len(d)), 0))
        later = (d != d[at]) | (p != p[at])
        d, p, n = as_runs(d[later], p[later])
        return known.iloc[d].assign(start=p, nwin=n)

    schema = "doc_id long, sub long, start int, nwin int, family long, deal int, words binary, docs binary, subs binary, starts binary"
    pieces = with_runs(docs, dealt, ("family", "share", "shares"), "inner").mapInArrow(cut, "doc_id long, sub long, start int, nwin int, family long, share int, shares int, body binary")
    sorted_ = stage(pieces.groupBy("family", "share").applyInPandas(sorted_shard, schema), "bytes-sorted")
    within = sorted_.filter("nwin > 0").select(*DOC, "start", "nwin")
    # A family's first windows are dealt by content to as many tasks as it has shards, so that none needs all of them.
    across = sorted_.filter("nwin = 0").groupBy("family", "deal").applyInPandas(merged, "doc_id long, sub long, start int, nwin int")
    found = stage(runs.unionByName(within).unionByName(across), "bytes-runs")
    unstage(segments, firsts, left, sorted_)
    return found


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, text_col: str = "text", id_col: str = "doc_id", digest: bool = True) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, and kept_sha256, or with digest=False kept (binary).

    A byte goes if it lies under a string of the given length that also starts earlier: in a smaller doc_id, or in the
    same document further left; strings may overlap and are judged on the input. Texts are UTF-8 bytes, and what is kept
    need not be valid UTF-8. A null or empty text has no bytes; a shorter text keeps all; repeated rows (one id, one text)
    share their decision; different texts of one id are documents of their own, in the order of their hashes; rows without
    an id come before all others; other columns are not looked at; very long texts are handled whole, one at a time; an
    empty table gives an empty one.
    """
    docs = keyed(documents_of(docs, text_col, id_col))
    docs = told_apart(docs, shared_ids(docs, "bytes"))
    last = "kept_sha256 string" if digest else "kept binary"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            row, start, nwin = runs_of(rows, offsets, 0, 1)
            gone = covered(len(data), offsets, row, start, nwin, length)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begins[inner] = gone[inner]
            raw = data[~gone].tobytes()
            to = np.append(0, np.cumsum(per_row(~gone, offsets)))
            parts = [raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
            value = pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()) if digest else pa.array(parts, pa.binary())
            columns = [pa.array(ids_of(rows)), pa.array(np.diff(offsets)), pa.array(per_row(gone, offsets)), pa.array(per_row(begins, offsets)), value]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    joined = with_runs(docs, removal_runs(docs, length, gram, shard_bytes))
    return unkeyed(joined.mapInArrow(kept, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read_table(spark, sf_dir, "documents"))
