"""Operator 13, spelling variant grouping: words one edit apart by two-dimensional range reporting on wavelet trees."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import column, read_table, stage, unstage

#: Words of fewer code points or occurrences are left out.
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A word takes a near word as its form if that occurs so many times as often.
FACTOR = 2
#: One in so many runs of a document loses a code point.
DAMAGE = 97
#: Letters that a group of words may have before its edit positions are halved, and letters of a shard of groups.
GROUP_LETTERS = 1 << 18
SHARD_LETTERS = 1 << 20
#: Code points of a text that are cut into runs at once, and words that a task counts before it sends them on.
PIECE = 1 << 20
HELD_WORDS = 200_000
#: Queries that go down a wavelet tree together.
QUERIES = 1 << 18

#: Latin-1 bytes: A-Z become lower case, letters stay, all else becomes a space.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


# ---------------------------------------------------------------- vocabulary

def runs_of(text: str) -> Counter:
    """How often each lower-cased run [A-Za-z\\u00C0-\\u00FF]+ occurs, as Latin-1 bytes, one byte a code point."""
    found: Counter = Counter()
    raw = text.encode("latin-1", "replace").translate(_RUNS)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE) if at + PIECE < len(raw) else -1
        to = len(raw) if to < 0 else to
        found.update(raw[at:to].split())
        at = to
    return found


def damaged(run: bytes, start: int, damage: int = DAMAGE) -> bytes:
    """The run, without one code point where its checksum says so. start: checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int = DAMAGE) -> DataFrame:
    """(word, n): distinct damaged runs of at least LEAST_LENGTH code points and LEAST_COUNT occurrences in all texts."""

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                start = zlib.crc32(f"{doc.as_py()}:".encode() if doc.is_valid else b":")
                for run, n in runs_of(text.as_py()).items():
                    if len(run) >= LEAST_LENGTH:
                        word = damaged(run, start, damage)
                        if len(word) >= LEAST_LENGTH:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield sent(held)
                    held = Counter()
        yield sent(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- groups

def _grouped(rows: DataFrame) -> DataFrame:
    """Adds gkey: what words of one class share that differ by an edit at a position from low to high - 1."""
    head = F.substring("word", F.lit(1), F.col("low"))
    tail = F.when(F.col("class") > F.col("high"), F.expr("right(word, class - high)")).otherwise("")
    return rows.withColumn("gkey", F.xxhash64("class", "low", "high", head, tail))


def groups(words: DataFrame, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """Staged (word, n, class, low, high, gkey): each word in every group where a near word may be.

    The class of two near words is the shorter one's length; a word is of the class of its own length and of that less one.
    If an edit is at a position from low to high - 1 (an insertion behind the end: high), the words share low code points
    in front and class - high at the end. Each class starts with two halves of the positions. Groups of one word, or with
    none of their class's own length, hold no pair and go; the positions of a group with too many letters are halved until
    it has fewer or one position, where all its words agree but for a letter.
    """
    size = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("class")).filter(F.col("class") >= LEAST_LENGTH)
    half = F.floor(F.col("class") / 2).cast("int")
    span: Column = F.explode(F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("class").alias("high"))))
    open_ = classes.select("word", "n", "class", span.alias("s")).select("word", "n", "class", "s.low", "s.high")
    parts = []
    while True:
        open_ = stage(_grouped(open_), "spell-groups")
        sums = open_.groupBy("gkey").agg(F.count(F.lit(1)).alias("words"), F.max(F.length("word") == F.col("class")).alias("own"), F.sum(F.length("word").cast("long")).alias("letters"))
        sums = sums.filter("words > 1 AND own").select("gkey", "letters")
        kept = stage(open_.join(sums, "gkey"), "spell-kept")
        unstage(open_)
        large = (F.col("letters") > group_letters) & (F.col("high") - F.col("low") > 1)
        parts.append(kept.filter(~large).select("word", "n", "class", "low", "high", "gkey"))
        if kept.filter(large).isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        span = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high")))
        open_ = kept.filter(large).select("word", "n", "class", span.alias("s")).select("word", "n", "class", "s.low", "s.high")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- wavelet trees

class Wavelet:
    """A wavelet tree over a permutation: which of the values in [c, d) stand at places in [a, b), for many (a, b, c, d) at once.

    One bit row for each bit of a value, from the highest; values with the bit go behind those without, in order.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 1
        self.ranks, self.zeros = [], []
        now = values
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit) & 1
            rank = np.zeros(self.n + 1, np.int64)
            np.cumsum(one, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(self.n - int(rank[-1]))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every point in a query's rectangle."""
        q = np.flatnonzero((a < b) & (c < d))
        lo, hi, value = a[q], b[q], np.zeros(len(q), np.int64)
        for level in range(self.bits):
            rank, zeros, width = self.ranks[level], self.zeros[level], 1 << (self.bits - 1 - level)
            one_lo, one_hi = rank[lo], rank[hi]
            q = np.concatenate([q, q])
            value = np.concatenate([value, value + width])
            lo, hi = np.concatenate([lo - one_lo, zeros + one_lo]), np.concatenate([hi - one_hi, zeros + one_hi])
            on = (lo < hi) & (value < d[q]) & (value + width > c[q])
            q, lo, hi, value = q[on], lo[on], hi[on], value[on]
        return q, value


def _bounds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, stop) of words as rows of bytes: the sorted order, and for each word and length of a prefix the places of all
    words that share it."""
    n, width = cells.shape
    order = np.lexsort(cells.T[::-1]) if width else np.arange(n)
    now = cells[order]
    first, stop = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), n, np.int32)
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for i in range(width):
        new[1:n] |= now[1:, i] != now[:-1, i]
        begin = np.flatnonzero(new)
        size = np.diff(begin)
        first[order, i + 1], stop[order, i + 1] = np.repeat(begin[:-1], size), np.repeat(begin[1:], size)
    return order, first, stop


def near_pairs(words: list[bytes], size: int, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) places of near words in a list of distinct words of size and size + 1 bytes, each once in one direction or both.

    Word row[k], of size bytes, is looked up for edits at the positions low[k] to high[k] - 1 (at size, too, if high[k] is
    that). For a replacement at i the words with its first i bytes are a stretch of the forward order, and those with its
    last size - i - 1 bytes one of the reverse order; for an insertion, those with its last size - i bytes. A pair with
    several insertion places is told at the last. Pairs come as (x, y) and (y, x), but replacements once for each of the
    two words that is looked up.
    """
    n = len(words)
    length = np.array([len(w) for w in words])
    cells = np.zeros((n, size + 1), np.uint8)
    raw = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(length) - length
    for width in (size, size + 1):
        mine = np.flatnonzero(length == width)
        cells[mine, :width] = raw[begin[mine][:, None] + np.arange(width)]
    back = np.where(np.arange(size + 1) < length[:, None], np.take_along_axis(cells, np.maximum(length[:, None] - 1 - np.arange(size + 1), 0), 1), 0)
    forward, f_first, f_stop = _bounds(cells)
    reverse, r_first, r_stop = _bounds(back)
    found = [(row[:0], row[:0])]
    for grown in (0, 1):
        mine = length == size + grown
        # Places among words of this length alone.
        at_f, at_r = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        np.cumsum(mine[forward], out=at_f[1:])
        np.cumsum(mine[reverse], out=at_r[1:])
        word_at = reverse[mine[reverse]]
        place = np.empty(n, np.int64)
        place[word_at] = np.arange(len(word_at))
        tree = Wavelet(place[forward[mine[forward]]])
        many = high - low + (grown & (high == size))
        stop = np.cumsum(many)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + QUERIES, "right")))
            k = np.repeat(np.arange(at, to), many[at:to])
            i = low[k] + np.arange(len(k)) - np.repeat(stop[at:to] - many[at:to] - (stop[at - 1] if at else 0), many[at:to])
            x, j = row[k], size - i - (1 - grown)
            q, value = tree.report(at_f[f_first[x, i]], at_f[f_stop[x, i]], at_r[r_first[x, j]], at_r[r_stop[x, j]])
            x, i, y = x[q], i[q], word_at[value]
            # Another word; and behind the place, the letters differ, so that no later place tells the same insertion.
            good = (x != y) & (cells[x, i] != cells[y, i])
            x, y = x[good], y[good]
            found += [(x, y), (y, x)] if grown else [(x, y)]
            at = to
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def links(words: DataFrame, group_letters: int = GROUP_LETTERS, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(word, n_near, best): how many words are near, and the most frequent of them as (n, word), for words that have any.

    Groups are dealt to shards; a shard's words of one class get two orders and wavelet trees. A pair is told in the one group
    of its class whose positions hold its edit, so that counts add up.
    """
    rows = groups(words, group_letters)
    total = rows.agg(F.sum(F.length("word").cast("long")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_letters))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("gkey", F.lit(13)), F.lit(shards)))

    def looked_up(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, mine in pdf.groupby("class"):
            known = mine.drop_duplicates("word")[["word", "n"]].reset_index(drop=True)
            texts, counts = known["word"].to_numpy(), known["n"].to_numpy(np.int64)
            number = pd.Series(np.arange(len(known)), index=texts)
            own = mine[mine["word"].str.len() == size]
            x, y = near_pairs([w.encode("latin-1") for w in texts], int(size), number.loc[own["word"]].to_numpy(np.int64), own["low"].to_numpy(np.int64), own["high"].to_numpy(np.int64))
            # By word, then the more frequent first, then in code-point order, which is the order of these bytes.
            rank = np.empty(len(texts), np.int64)
            rank[np.argsort(texts)] = np.arange(len(texts))
            by = np.lexsort((rank[y], -counts[y], x))
            x, y = x[by], y[by]
            lead = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
            out.append(pd.DataFrame({"word": texts[x[lead]], "n_near": np.diff(np.append(lead, len(x))), "best_n": counts[y[lead]], "best": texts[y[lead]]}))
        return pd.concat(out, ignore_index=True)

    found = dealt.groupBy("shard").applyInPandas(looked_up, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best"))


# ---------------------------------------------------------------- forms

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain, by pointer jumping. A form is more frequent than its word, so
    chains end; a round halves what is left of them, and a few rounds settle any counts of 64 bits."""
    jumps = stage(forms.select("word", F.col("form").alias("root")), "spell-jumps")
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = stage(jumps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-jumps")
        unstage(jumps)
        jumps = far.select("word", "root")
        if far.filter("moved").isEmpty():
            return jumps


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int = DAMAGE, group_letters: int = GROUP_LETTERS, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """One row a word of the corpus: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, lower-cased A-Z, of which one in `damage` (by a checksum of document and run) has lost
    a code point; shorter than five code points or rarer than three they are left out. Near words differ by one inserted,
    deleted or replaced code point. A word's form is its most frequent near word (of equals the first in code-point order)
    if that occurs at least twice as often; its root is where the forms lead.

    Null and empty texts have no words; a text without an id has an empty one in the checksum; repeated rows count as often
    as they occur; very long texts and runs are handled whole; other columns are not looked at; an empty table gives an
    empty one.
    """
    words = stage(vocabulary(docs, text_col, id_col, damage), "spell-words")
    found = stage(links(words, group_letters, shard_letters), "spell-links")
    judged = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= FACTOR * F.col("n"), F.col("best")).alias("best"))
    judged = stage(judged.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n")), "spell-judged")
    unstage(words, found)
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))
