"""Operator 1, line dedup: an exact set-similarity join of lines, in DataFrame operations only."""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import read_table, stage, unstage
from tarnstone.llm.quality_rules import let, words_column
from tarnstone.llm.repeats import keyed, unkeyed

#: Jaccard similarity of token sets in hundredths.
SIMILARITY = 80
#: Classes of token hashes whose counts give rarity: one bounded table, whatever the size of the corpus.
BITS = 18
CLASSES = 1 << BITS
#: Classes that are counted in one row, which keeps the table of a task's counts in its processor's cache.
TOGETHER = 4
#: Steps of the rarity order for each doubling of a count, and steps in all: what fits a character.
STEPS = 4
LEVELS = 128
#: Tokens counted so often give prefixes of token pairs, which keeps what one key gathers from growing with the corpus.
FREQUENT = 4096
#: Shares of all tokens, rarest first, whose parity the two words of a signature hold; the commonest tokens tell sets apart least.
SIGNED = (0.3, 0.6)
#: Tokens of a prefix, of the least hashes, by which each line is compared with one early and one often copied line.
SAMPLE = 2
#: Sets of one sampled token from which on they are compared with two of them; pairs of rarer tokens are left to the join.
CROWD = 96
#: Sets that go, of one token, from which on the sets that are left are compared with PIVOTS of that token's sets.
DENSE = 24
PIVOTS = 32
#: Rows of a few numbers up to which a written table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
LINE = "\n"


def level(count: int) -> int:
    """The step of a count in the rarity order."""
    return min(LEVELS - 1, int(STEPS * math.log2(count + 1)))


def _pieces(line: Column) -> Column:
    """The words of a line, and empty strings: a split at single spaces, which needs no pattern; other white space is rare and turned first."""
    others = "\t\x0b\f\r"
    odd = F.translate(line, others, " " * len(others))
    plain = F.when(line.contains("\t") | line.contains("\x0b") | line.contains("\f") | line.contains("\r"), odd).otherwise(line)
    return F.split(plain, " ")


def token_hashes(line: Column) -> Column:
    """The hashes of the distinct words of a line."""
    return F.array_remove(F.array_distinct(F.transform(_pieces(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def rarity(docs: DataFrame) -> tuple[Column, list[int]]:
    """The level of each hash class, from token counts over the whole corpus: a constant of CLASSES small numbers. And the
    levels that the shares SIGNED of all tokens lie below.

    The driver sees one count a class, CLASSES numbers at most.
    """
    words = docs.select(F.explode(F.split("text", LINE, -1)).alias("line")).select(F.explode(_pieces(F.col("line"))).alias("w"))
    token = words.filter("w <> ''").select(F.xxhash64("w").bitwiseAND(CLASSES - 1).cast("int").alias("class"))
    at, part = F.shiftright("class", TOGETHER.bit_length() - 1), F.col("class").bitwiseAND(TOGETHER - 1)
    found = token.groupBy(at.alias("at")).agg(*[F.count(F.when(part == i, 1)).alias(f"n{i}") for i in range(TOGETHER)]).collect()
    levels, tokens = [level(0)] * CLASSES, [0] * LEVELS
    for r in found:
        for i, n in enumerate(r[1:]):
            levels[r["at"] * TOGETHER + i] = at = level(n)
            tokens[at] += n
    below = list(itertools.accumulate(tokens, initial=0))
    # The array is folded once, when the plan is made.
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>"), [bisect.bisect_left(below[:-1], share * below[-1]) for share in SIGNED]


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "tkey", F.posexplode(F.split("text", LINE, -1)).alias("line_no", "line"))


def ordered_tokens(hashes: Column, levels: Column, *marks: Column) -> Column:
    """Tokens, rarest first, as numbers: the level of the token's class above, 56 bits of its hash below. And marks among them."""
    return F.sort_array(F.concat(F.array(*marks), F.transform(hashes, lambda h: F.shiftleft(levels[h.bitwiseAND(CLASSES - 1).cast("int")], 56).bitwiseOR(F.shiftrightunsigned(h, 8)))))


def _base(n: Column, similarity: int) -> Column:
    """Tokens in the prefix of a set of n: two sets so similar share one of them. None if only an equal set is similar."""
    return F.when(n * 100 >= similarity * (n + 1), n - F.ceil(n * similarity / 100).cast("int") + 1).otherwise(0)


def _inner(n: Column, similarity: int) -> Column:
    """Tokens in the prefix of a set of n that is the smaller of a pair: no more than leave the overlap with a set of its own size."""
    return n - F.ceil(n * 2 * similarity / (100 + similarity)).cast("int") + 1


def _parity(tokens: Column) -> Column:
    """64 bits: whether an odd number of tokens falls into each class. Two sets differ in at least as many tokens as bits."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))


def line_sets(docs: DataFrame, similarity: int) -> DataFrame:
    """doc_id, tkey, line_no, n, s1, s2, sign, half, prefix of every line with tokens. Lines of equal token sets have equal s1, s2.

    The prefix is longer by one token than _base says, for the pairs of frequent tokens. sign and half: the parity of the
    tokens below the first level that rarity tells, and of those between the first and the second.
    """
    levels, (low, high) = rarity(docs)
    # Exploding the one-element array works the hashes out once. What stands inside a lambda function's call runs uncompiled,
    # so the distinct hashes are a column before they become numbers.
    hashes = lines_of(docs).select("doc_id", "tkey", "line_no", F.explode(F.array(token_hashes(F.col("line")))).alias("h")).filter(F.size("h") > 0)
    # Where the marks come to stand among the sorted tokens, the levels end.
    marks = [F.lit(low << 56).cast("long"), F.lit((high << 56) + 1).cast("long")]
    all_ = hashes.select("doc_id", "tkey", "line_no", ordered_tokens(F.col("h"), levels, *marks).alias("all"))
    ends = [F.array_position("all", m).cast("int") for m in marks]
    placed = all_.select("doc_id", "tkey", "line_no", "all", ends[0].alias("a"), ends[1].alias("b"))
    rare, middle = F.slice("all", F.lit(1), F.col("a") - 1), F.slice("all", F.col("a") + 1, F.col("b") - F.col("a") - 1)
    rest = F.slice("all", F.col("b") + 1, F.size("all") - F.col("b"))
    parts = placed.select("doc_id", "tkey", "line_no", rare.alias("rare"), middle.alias("middle"), F.concat(rare, middle, rest).alias("t"))
    n, base = F.size("t"), _base(F.size("t"), similarity)
    prefix = F.slice("t", F.lit(1), F.when(base > 0, base + 1).otherwise(0))
    return parts.select("doc_id", "tkey", "line_no", n.alias("n"), F.xxhash64("t").alias("s1"), F.hash("t").alias("s2"), _parity(F.col("rare")).alias("sign"), _parity(F.col("middle")).alias("half"), prefix.alias("prefix"))


def postings(sets: DataFrame, similarity: int, index: Column | None = None) -> DataFrame:
    """key, n, pos, and columns of the set, for each prefix token of each set.

    Where index holds, the set is only looked for as the smaller of a pair, or the first of two equally large, and gets the
    shorter prefix of _inner.

    A frequent token is no key itself: each pair of it with a later token of the prefix, which is longer by one, is. Two
    similar sets share two tokens of the longer prefixes, the first of them in the shorter ones. Sets that may have a
    partner with which they share one token alone keep the single key.
    """
    row = [c for c in sets.columns if c != "prefix"]
    n, base = F.col("n"), _base(F.col("n"), similarity)
    if index is not None:
        base = F.when(index, _inner(n, similarity)).otherwise(base)
    each = sets.select(*row, "prefix", F.posexplode(F.slice("prefix", F.lit(1), base)).alias("pos", "token"))
    frequent = F.col("token") >= level(FREQUENT) * (1 << 56)
    single = each.filter(~frequent | (n * similarity * similarity < 20000)).select(F.col("token").alias("key"), "pos", *row)
    after = F.transform(F.slice("prefix", F.col("pos") + 2, F.size("prefix")), lambda u: F.xxhash64("token", u))
    # The last token of a prefix is its most frequent one.
    some = sets.filter(F.element_at("prefix", F.lit(-1)) >= level(FREQUENT) * (1 << 56))
    each = some.select(*row, "prefix", F.posexplode(F.slice("prefix", F.lit(1), base)).alias("pos", "token"))
    double = each.filter(frequent & (n * similarity >= 200)).select(F.explode(after).alias("key"), "pos", *row)
    return single.unionByName(double)


def _alike(similarity: int) -> Column:
    """Length filter and parity filter of two sets x and y."""
    nx, ny = F.col("nx"), F.col("ny")
    differ = F.bit_count(F.col("gx").bitwiseXOR(F.col("gy"))) + F.bit_count(F.col("hx").bitwiseXOR(F.col("hy")))
    return (100 * F.least(nx, ny) >= similarity * F.greatest(nx, ny)) & (differ * (100 + similarity) <= (nx + ny) * (100 - similarity))


def _placed(similarity: int) -> Column:
    """Positional filter: the overlap that two sets need lies in their tokens from the first one that they share.

    x must be one that is looked for (second bit of its use), y one that searches (first bit). As factors, these keep both
    sides of the join the same rows, which are then shuffled once.
    """
    used = F.shiftright("ux", 1) * F.col("uy").bitwiseAND(1)
    return F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + similarity) * used >= (F.col("nx") + F.col("ny")) * similarity


def _side(rows: DataFrame, c: str) -> DataFrame:
    names = (("sid", "s"), ("doc_id", "d"), ("n", "n"), ("pos", "p"), ("use", "u"), ("sign", "g"), ("half", "h"))
    return rows.select("key", *[F.col(a).alias(f"{b}{c}") for a, b in names])


def _small(staged: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows (else the staged table), broadcast if the staged table they come from is counted to be small."""
    rows = staged if rows is None else rows
    return F.broadcast(rows) if staged.count() <= BROADCAST_ROWS else rows


def _later(pairs: DataFrame, sets: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """Staged (sid): of each pair (sx, sy) of sets that is similar enough, the later one. The lines are read again."""
    pairs = stage(pairs.distinct(), "line-candidates")
    wanted = pairs.select(F.col("sx").alias("sid")).unionByName(pairs.select(F.col("sy").alias("sid"))).distinct()
    wanted = stage(sets.select("sid", "doc_id", "tkey", "line_no").join(_small(pairs, wanted), "sid"), "line-wanted")
    lists = _small(wanted, wanted.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("line_no", "sid")).alias("lines")))
    each = let(F.split("text", LINE, -1), lambda all_: F.transform("lines", lambda at: F.struct(at["line_no"].alias("line_no"), at["sid"].alias("sid"), F.get(all_, at["line_no"]).alias("line"))))
    text = docs.join(lists, ["doc_id", "tkey"]).select("doc_id", "tkey", F.explode(each).alias("l"))
    found = token_hashes(F.col("l.line"))
    # Repeated rows of one id and text give the same lines.
    tokens = text.select(F.col("l.sid").alias("sid"), F.struct("doc_id", "tkey", "l.line_no").alias("at"), found.alias("tokens")).dropDuplicates(["sid"])
    tokens = stage(tokens, "line-tokens")
    of = lambda c: tokens.select(F.col("sid").alias(f"s{c}"), F.col("at").alias(f"at{c}"), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(of("x"), "sx").join(of("y"), "sy")
    same = F.size(F.array_intersect("tx", "ty"))
    near = both.filter(100 * same >= similarity * (F.size("tx") + F.size("ty") - same))
    later = stage(near.select(F.when(F.col("atx") < F.col("aty"), F.col("sy")).otherwise(F.col("sx")).alias("sid")).distinct(), "line-later")
    unstage(pairs, wanted, tokens)
    return later


def _bare(rows: DataFrame, c: str, *more: str) -> DataFrame:
    return rows.select(*more, *[F.col(a).alias(f"{b}{c}") for a, b in (("sid", "s"), ("n", "n"), ("sign", "g"), ("half", "h"))])


def _near_pivots(live: DataFrame, similarity: int) -> DataFrame:
    """(sx, sy): each set beside the most copied and the earliest set for some of its tokens.

    Most lines of a dense group share one of the prefix tokens with the least hashes, so most of them meet one line that is
    like them all, without their pairs being listed. Tokens of fewer than CROWD sets are left out.
    """
    hashed = F.transform(F.slice("prefix", F.lit(1), F.size("prefix") - 1), lambda t: F.xxhash64(t))
    least = F.explode(F.slice(F.sort_array(hashed), 1, SAMPLE)).alias("key")
    dense = live.select(least).groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") >= CROWD).select("key")
    dense = stage(dense, "line-dense")
    ends = live.select("sid", "doc_id", "n", "sign", "half", "copies", least)
    ends = stage(ends.join(_small(dense), "key"), "line-ends")
    found = ends.groupBy("key").agg(F.max_by("sid", "copies").alias("a"), F.min_by("sid", "doc_id").alias("b"))
    found = found.select("key", F.explode(F.array_distinct(F.array("a", "b"))).alias("sid"))
    pivots = _bare(ends.join(found, ["key", "sid"]), "y", "key")
    near = _bare(ends, "x", "key").join(pivots, "key").filter((F.col("sx") != F.col("sy")) & _alike(similarity))
    out = stage(near.select("sx", "sy").distinct(), "line-near")
    unstage(dense, ends)
    return out


def _near_dense(live: DataFrame, gone: DataFrame, similarity: int) -> DataFrame:
    """(sx, sy): each set that is left, beside some sets for each of its tokens that stand in many sets that go."""
    marked = live.join(_small(gone, gone.withColumn("shut", F.lit(True))), "sid", "left")
    each = postings(marked.select("sid", "doc_id", "n", "sign", "half", "prefix", "shut"), similarity)
    dense = each.filter("shut").groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") >= DENSE).select("key")
    dense = stage(dense, "line-dense")
    each = stage(each.join(_small(dense), "key"), "line-dense-postings")
    pivots = each.groupBy("key", F.pmod(F.xxhash64("sid"), F.lit(PIVOTS)).alias("share")).agg(F.min_by("sid", "doc_id").alias("sid"))
    pivots = _bare(each.join(pivots.select("key", "sid"), ["key", "sid"]), "y", "key")
    near = _bare(each.filter("shut IS NULL"), "x", "key").join(pivots, "key").filter((F.col("sx") != F.col("sy")) & _alike(similarity))
    out = stage(near.select("sx", "sy").distinct(), "line-near")
    unstage(dense, each)
    return out


def duplicate_lines(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Staged (doc_id, tkey, line_no) of lines that have an earlier line, by document and then line number, at least so similar.

    docs: doc_id, tkey, text, none null. Earlier lines count whether or not they go themselves. Lines without tokens stay.
    """
    lines = stage(line_sets(docs, similarity), "line-keys")
    # Lines with equal token sets: the first one stands for all from here on.
    at = F.min(F.struct("doc_id", "tkey", "line_no")).alias("at")
    sets = lines.groupBy("s1", "s2").agg(at, F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "sign", "half", "prefix")])
    sets = stage(sets.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "at.*", "copies", "n", "sign", "half", "prefix"), "line-sets")
    light = stage(lines.select("doc_id", "tkey", "line_no", "s1", "s2"), "line-light")
    unstage(lines)

    live = sets.filter(F.size("prefix") > 0)
    ends = _near_pivots(live, similarity)
    some = _later(ends, sets, docs, similarity)
    near = _near_dense(live, some, similarity)
    more = _later(near, sets, docs, similarity)
    gone = stage(some.unionByName(more).distinct(), "line-later")
    unstage(ends, some, near, more)

    # Every set that is left is searched for among all others: among those left, as the larger of a pair, and among the rest.
    # All postings are shuffled once, for both sides of the join.
    marked = live.select("sid", "doc_id", "n", "sign", "half", "prefix").join(_small(gone, gone.withColumn("shut", F.lit(True))), "sid", "left").withColumn("open", F.col("shut").isNull()).drop("shut")
    use = F.col("open").cast("int") + F.when(~F.col("open") | (F.col("pos") < _inner(F.col("n"), similarity)), 2).otherwise(0)
    each = postings(marked, similarity, ~F.col("open")).withColumn("use", use)
    x, y = _side(each, "x"), _side(each, "y")
    ordered = F.expr("IF(ux <> 2, nx < ny OR nx = ny AND sx < sy, dx <= dy)")
    pairs = x.join(y, (x["key"] == y["key"]) & _placed(similarity) & _alike(similarity) & ordered).select("sx", "sy")
    rest = _later(pairs, sets, docs, similarity)

    near = stage(gone.unionByName(rest).distinct().withColumn("near", F.lit(True)), "line-decided")
    marked = sets.select("sid", "s1", "s2", F.struct("doc_id", "tkey", "line_no").alias("first"), "copies").join(_small(near), "sid", "left").filter("near OR copies > 1")
    out = light.join(marked, ["s1", "s2"]).filter(F.col("near").isNotNull() | (F.struct("doc_id", "tkey", "line_no") != F.col("first")))
    out = stage(out.select("doc_id", "tkey", "line_no").distinct(), "line-gone")
    unstage(light, sets, gone, rest, near)
    return out


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """row, doc_id, tkey, text of every row; a text is told from another of its id by its hash."""
    return keyed(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))


def _kept(rows: DataFrame, similarity: int) -> DataFrame:
    """rows with gone (line numbers, null where all stay) and kept (the text that is left)."""
    base = rows.select("doc_id", "tkey", F.coalesce("text", F.lit("")).alias("text"))
    gone = duplicate_lines(base, similarity).groupBy("doc_id", "tkey").agg(F.collect_set("line_no").alias("gone"))
    lines = F.filter(F.split("text", LINE, -1), lambda _, i: ~F.array_contains("gone", i))
    return rows.join(gone, ["doc_id", "tkey"], "left").withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines, LINE)))


def dedup_lines(docs: DataFrame, similarity: int = SIMILARITY, text_col: str = "text", id_col: str = "doc_id", drop_emptied: bool = False) -> DataFrame:
    """docs with each text stripped of lines that nearly repeat an earlier one; every other column is kept as it is.

    Two lines match if the Jaccard similarity of their sets of words [^\\x20\\x09-\\x0D]+ is at least similarity / 100. A
    line goes if any earlier line of the corpus matches it: in a smaller doc_id, or above it in the same text. Null and
    empty texts and lines without words stay. Rows without an id come before all others; different texts of one id, or
    without one, are documents of their own, in the order of their hashes; rows that repeat an id and its text share the
    decision. Very long texts and lines are handled whole; an empty table gives an empty one. A text that loses all lines
    becomes empty; with drop_emptied, rows go whose text had words and has none left.
    """
    out = _kept(_rows(docs, text_col, id_col), similarity)
    if drop_emptied:
        out = out.filter(F.col("gone").isNull() | (F.size(words_column(F.col("kept"))) > 0))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, n_lines (lines of a null text: none), n_removed, kept_sha256 of what dedup_lines keeps."""
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", LINE, -1))).cast("long")
    out = _kept(_rows(docs.select("doc_id", "text"), "text", "doc_id").drop("row"), similarity)
    gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return unkeyed(out.select("doc_id", count.alias("n_lines"), gone.alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))
