"""Operator 12, vector code compression: product codes by Lloyd rounds that filter codebook entries down kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import column, read_table, stage, unstage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of one tree; a task cuts its rows into trees of this size, which bounds its memory.
TREE_ROWS = 4096
#: Vectors of a leaf, which are compared one by one with the entries left.
LEAF = 16
#: Numbers that a step over (node, entry) pairs holds at once.
STEP = 1 << 20
#: Labels up to which their totals are broadcast.
BROADCAST_LABELS = 100_000
TREE = "dim int, n int, width int, perm binary, points binary, lows binary, highs binary, sums binary, start_ids array<long>, start_vecs array<array<long>>, ids array<long>, labels array<{label}>"


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end; the parts are equal if dim is a multiple of their number."""
    return [dim * i // parts for i in range(parts + 1)]


def levels(n: int) -> int:
    """Levels below the root: nodes of level k hold the places (i * n >> k) to ((i + 1) * n >> k)."""
    return max(0, int(np.ceil(np.log2(n / LEAF)))) if n else 0


def edges(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


class Tree:
    """A kd-tree over the rows of points: in perm order, with the box and the sum of every node, level after level.

    A node is halved at the median of its widest side. Counts follow from the places of a node.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        perm, lows, highs, sums = np.arange(n), [], [], []
        for level in range(levels(n) + 1):
            cut, now = edges(n, level), points[perm]
            lows.append(np.minimum.reduceat(now, cut[:-1]))
            highs.append(np.maximum.reduceat(now, cut[:-1]))
            sums.append(np.add.reduceat(now, cut[:-1]))
            if level < levels(n):
                node = np.repeat(np.arange(1 << level), np.diff(cut))
                side = np.argmax(highs[-1] - lows[-1], axis=1)
                perm = perm[np.lexsort((now[np.arange(n), side[node]], node))]
        self.perm, self.points = perm, points[perm]
        self.lows, self.highs, self.sums = (np.concatenate(x) for x in (lows, highs, sums))

    @classmethod
    def of(cls, perm: np.ndarray, points: np.ndarray, lows: np.ndarray, highs: np.ndarray, sums: np.ndarray) -> Tree:
        tree = cls.__new__(cls)
        tree.perm, tree.points, tree.lows, tree.highs, tree.sums = perm, points, lows, highs, sums
        return tree

    def filtered(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each place, sums by entry, counts by entry) for the nearest entries, the lower of two as near.

        From the root down, an entry leaves a node if another is nearer over the whole box. A node with one entry left is
        assigned as a whole, by its sum and count; leaves with several compare their vectors with those.
        """
        n, k = len(self.points), len(book)
        norm = (book * book).sum(1)
        total, count, codes = np.zeros_like(book), np.zeros(k, np.int64), np.zeros(n, np.int64)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(levels(n) + 1):
            base, cut = (1 << level) - 1, edges(n, level)
            low, high = self.lows[base + nodes], self.highs[base + nodes]
            rows = max(1, STEP // (k * book.shape[1]))
            for at in range(0, len(nodes), rows):
                alive[at : at + rows] = narrowed(low[at : at + rows], high[at : at + rows], alive[at : at + rows], book, norm)
            one = alive.sum(1) == 1
            done, entry = nodes[one], alive[one].argmax(1)
            np.add.at(total, entry, self.sums[base + done])
            np.add.at(count, entry, cut[done + 1] - cut[done])
            for a, b, e in zip(cut[done], cut[done + 1], entry, strict=True):
                codes[a:b] = e
            nodes, alive = nodes[~one], alive[~one]
            if level < levels(n):
                nodes, alive = (nodes[:, None] * 2 + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0)
        for node, left in zip(nodes, alive, strict=True):
            a, b, some = cut[node], cut[node + 1], np.flatnonzero(left)
            codes[a:b] = some[np.argmin(norm[some] - 2 * (self.points[a:b] @ book[some].T), axis=1)]
            np.add.at(total, codes[a:b], self.points[a:b])
            np.add.at(count, codes[a:b], 1)
        return codes, total, count


def narrowed(low: np.ndarray, high: np.ndarray, alive: np.ndarray, book: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The entries left of alive (nodes x entries) in the boxes.

    The difference of the distances to two entries is linear, so its least value over a box is at the corner that lies
    furthest towards the other one; an entry goes if it is farther than the one nearest to the middle even there, or as
    far and of a higher index.
    """
    row, entry = np.nonzero(alive)
    begin = np.searchsorted(row, np.arange(len(alive)))
    off = (low + high)[row] - 2 * book[entry]
    off = np.einsum("ij,ij->i", off, off)
    least = np.flatnonzero(off == np.minimum.reduceat(off, begin)[row])
    near = entry[least[np.searchsorted(row[least], np.arange(len(alive)))]][row]
    way = book[entry] - book[near]
    corner = np.where(way > 0, high[row], low[row])
    gap = norm[entry] - norm[near] - 2 * np.einsum("ij,ij->i", way, corner)
    stays = (gap < 0) | ((gap == 0) & (entry <= near))
    out = np.zeros_like(alive)
    out[row[stays], entry[stays]] = True
    return out


def integers(x: np.ndarray, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x). Components too large for squared distances of 64 bits count as the largest that is not."""
    most = int(np.sqrt(2**61 / max(1, dim)))
    return np.clip(np.floor(x.astype(np.float64) * scale), -most, most).astype(np.int64)


def least_ids(ids: np.ndarray, none: np.ndarray, vecs: np.ndarray, entries: int) -> np.ndarray:
    """Rows of the least ids (those without one last and as one), and of an id's rows the one of the least vector."""
    by = np.lexsort((ids, none))
    new = np.ones(len(by), bool)
    new[1:] = (ids[by][1:] != ids[by][:-1]) | (none[by][1:] != none[by][:-1])
    by = by[np.cumsum(new) <= entries]
    by = by[np.lexsort((*vecs[by].T[::-1], ids[by], none[by]))]
    new = np.ones(len(by), bool)
    new[1:] = (ids[by][1:] != ids[by][:-1]) | (none[by][1:] != none[by][:-1])
    return by[new]


def grow(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, parts: int, entries: int) -> DataFrame:
    """Staged trees: a row for each tree, with a tree for each part position, and the least ids of its rows."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.filter(vec.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), label.alias("label"))

    def planted(ids: pa.Array, labels: pa.Array, vecs: np.ndarray) -> pa.RecordBatch:
        n, dim = vecs.shape
        cut = cuts(dim, parts)
        trees = [Tree(vecs[:, a:b] if b > a else np.zeros((n, 1), np.int64)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        most = int(np.abs(vecs).max()) if vecs.size else 0
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        put = lambda name, kind: b"".join(getattr(t, name).astype(kind).tobytes() for t in trees)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        first = least_ids(known, none, vecs, entries)
        one = pa.array([0, n], pa.int32())
        columns = {
            "dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int32()), "width": pa.array([width], pa.int32()), "perm": pa.array([put("perm", np.int32)], pa.binary()),
            **{c: pa.array([put(c, f"i{width}")], pa.binary()) for c in ("points", "lows", "highs")}, "sums": pa.array([put("sums", np.int64)], pa.binary()),
            "start_ids": pa.array([ids.take(pa.array(first)).to_pylist()], pa.list_(pa.int64())), "start_vecs": pa.array([vecs[first].tolist()], pa.list_(pa.list_(pa.int64()))),
            "ids": pa.ListArray.from_arrays(one, ids), "labels": pa.ListArray.from_arrays(one, labels),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def trees() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, vec, labels = (table.column(c).combine_chunks() for c in ("id", "vec", "label"))
            offsets = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                vecs = integers(flat[offsets[mine][:, None] + np.arange(dim)], int(dim))
                yield planted(ids.take(pa.array(mine)), labels.take(pa.array(mine)), vecs)

        for batch in batches:
            at = 0
            while at < len(batch):
                take = batch.slice(at, TREE_ROWS - n)
                held.append(take)
                at, n = at + len(take), n + len(take)
                if n == TREE_ROWS:
                    yield from trees()
                    held, n = [], 0
        if n:
            yield from trees()

    return stage(rows.mapInArrow(build, TREE.format(label=dict(rows.dtypes)["label"])), "vector-trees")


def unpacked(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, list[Tree]]]:
    """(row of the batch, the tree of each part)."""
    for i in range(len(batch)):
        dim, n, width = (column(batch, c)[i].as_py() for c in ("dim", "n", "width"))
        cut, nodes = cuts(dim, parts), 2 ** (levels(n) + 1) - 1
        sides = [max(1, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        raw = {c: np.frombuffer(column(batch, c)[i].as_buffer(), kind) for c, kind in (("perm", np.int32), ("points", f"i{width}"), ("lows", f"i{width}"), ("highs", f"i{width}"), ("sums", np.int64))}
        trees, done = [], 0
        for p, side in enumerate(sides):
            cells = [raw[c][done * m : (done + side) * m].reshape(m, side).astype(np.int64) for c, m in (("points", n), ("lows", nodes), ("highs", nodes), ("sums", nodes))]
            trees.append(Tree.of(raw["perm"][p * n : (p + 1) * n], *cells))
            done += side
        yield i, trees


def starts(trees: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the least ids, of the length that the least id has: at most the entries of a codebook."""
    listed = trees.select("dim", F.explode(F.arrays_zip("start_ids", "start_vecs")).alias("s")).groupBy("dim", F.col("s.start_ids").alias("id")).agg(F.min("s.start_vecs").alias("vec"))
    first = listed.orderBy(F.col("id").asc_nulls_last(), "vec").limit(1).collect()
    if not first:
        return []
    return [r.vec for r in listed.filter(F.col("dim") == first[0].dim).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]


def books_of(rows: list[list[int]], parts: int) -> list[np.ndarray]:
    vecs = np.array(rows, np.int64).reshape(len(rows), len(rows[0]) if rows else 0)
    cut = cuts(vecs.shape[1], parts)
    return [vecs[:, a:b] if b > a else np.zeros((len(vecs), 1), np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def lloyd(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the floors of the means of what is assigned to each entry; unused entries stay.

    A task sends the sums and counts of its trees, a row for each used entry; the driver gets as many as there are entries.
    """
    parts, most = len(books), max(b.shape[1] for b in books)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, each in unpacked(batch, parts):
                for p, tree in enumerate(each):
                    _, total, count = tree.filtered(books[p])
                    totals[p] += total
                    counts[p] += count
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used]), pa.array(totals[p][used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = trees.mapInArrow(gathered, "part int, entry int, n long, total array<long>").groupBy("part", "entry")
    new = [b.copy() for b in books]
    for r in sums.agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(most)]).collect():
        side = books[r.part].shape[1]
        new[r.part][r.entry] = np.array([r[f"t{i}"] for i in range(side)], np.int64) // r.n
    return new


def digest(books: list[np.ndarray], dim: int) -> str:
    cut = cuts(dim, len(books))
    numbers = [str(x) for b, a, z in zip(books, cut[:-1], cut[1:], strict=True) for x in b[:, : z - a].ravel().tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def encode(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row a kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Null vectors and those with null or infinite components or NaN go, and so do vectors of another length than the one
    of the least id. Rows that repeat an id are coded each; the codebooks start from distinct ids, of rows of one id from
    the least vector, and rows without an id come last and count as one id. Fewer ids than entries give shorter codebooks.
    Lengths that are no multiple of the parts are cut as evenly as they go; empty vectors have code 00 in each part.
    Equal labels add up, nulls together. Components of more than about 2^30 / sqrt(length) after scaling count as that.
    Other columns are not looked at; an empty table gives an empty one.

    Each partition's rows become kd-trees once, written to the shared folder; every round reads the trees, and only sums
    by entry are shuffled.
    """
    trees = grow(df, id_col, vec_col, label_col, parts, entries)
    label = dict(trees.dtypes)["labels"][6:-1]
    first = starts(trees, entries)
    dim = len(first[0]) if first else 0
    books = books_of(first, parts)
    mine = trees.filter(F.col("dim") == dim)
    for _ in range(rounds if first else 0):
        books = lloyd(mine, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, each in unpacked(batch, parts):
                n = len(each[0].points)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(each):
                    entry, _, _ = tree.filtered(books[p])
                    off = tree.points - books[p][entry]
                    codes[tree.perm, p] = entry
                    error[tree.perm] += np.einsum("ij,ij->i", off, off)
                text = codes.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([column(batch, "ids")[i].values, pa.array([text[k : k + step] for k in range(0, step * n, step)], pa.string()), pa.array(error), column(batch, "labels")[i].values], ["vec_id", "code", "error", "label"])

    codes = stage(mine.mapInArrow(coded, f"vec_id long, code string, error long, label {label}"), "vector-codes")
    unstage(trees)
    totals = stage(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels")
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books, dim) if first else None).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "embeddings"))
