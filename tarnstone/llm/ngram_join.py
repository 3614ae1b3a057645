"""Operator 4, n-gram Jaccard join: adaptive multi-match prefixes over shingle sets, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import chunks, documents_of, mix, prefix_sums, read_table, signed, slice_hash, stage, unstage, words_of
from tarnstone.llm.components import components
from tarnstone.llm.repeats import NO_ID, ids_of, keyed, shared_ids, told_apart, unkeyed

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Longest extension of a prefix, and the number of shared tokens it then takes.
LEVELS = 4
#: Rarer tokens that a posting remembers, so that a pair of documents is listed once and not for each token they share.
LOOKBACK = 16
#: Words of 64 bits in a document's parity signature.
PARITY = 16
#: Rounds that link every document of a posting list with one of it before all remaining pairs are listed.
PIVOT_ROUNDS = 3


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; a document of fewer than k words is one shingle."""
    _, _, words, first = words_of(data, offsets, lower=True)
    sums = prefix_sums(words)
    at = np.arange(max(0, len(words) - k + 1))
    grams = slice_hash(sums, at, at + k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(slice_hash(sums, np.array([a]), np.array([b])) if b > a else words[:0])
    return out


def least_overlap(n: np.ndarray, similarity: int) -> np.ndarray:
    """Shared shingles that a set of n needs with any partner."""
    return -(-n * similarity // 100)


def _sketches(k: int, similarity: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, k)
            n = np.array([len(s) for s in sets], np.int64)
            need = 1 + n // 20
            size = np.minimum(n, n - least_overlap(n, similarity) + need)
            sums = [[int(np.sum(mix(s ^ np.uint64(c)), dtype=np.uint64)) for s in sets] for c in (0x51, 0xA7000000)]
            sums = [signed(np.array(x, np.uint64)) for x in sums]
            values = np.concatenate([s[:m] for s, m in zip(sets, size.tolist(), strict=True)] or [np.zeros(0, np.uint64)])
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(signed(values)))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(need), prefix], ["doc_id", "n", "s1", "s2", "need", "prefix"])

    return sketched


def _shingles(k: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            sets = shingle_sets(data, offsets, k)
            n = np.array([len(s) for s in sets], np.int64)
            columns = [np.repeat(ids_of(rows), n), np.repeat(n, n), signed(np.concatenate(sets))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n", "h"])

    return listed


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of pairs (x, y) whose sets are similar enough. Shingles of one document alone never lie in an intersection.

    First x's level counts: of the prefixes lengthened to it, both must share that many tokens.
    """
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), "base", "level", F.col("tokens").alias(f"t{c}"))
    both = pairs.join(side("x"), "x").join(side("y").select("y", "ny", "ty", F.col("base").alias("basey")), "y")
    front = lambda t, base: F.slice(t, F.lit(1), F.greatest(F.lit(0), F.col(base) + F.col("level") - 1))
    both = both.filter(F.size(F.array_intersect(front("tx", "base"), front("ty", "basey"))) >= F.col("level"))
    same = F.size(F.array_intersect("tx", "ty"))
    return both.filter(100 * same >= similarity * (F.col("nx") + F.col("ny") - same)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _parity(tokens: Column) -> Column:
    """A bit for each of 64 * PARITY token classes: whether an odd number of tokens falls into it.

    Two sets differ in at least as many tokens as their signatures differ in bits.
    """
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 10).bitwiseAND(63).cast("int"))
    word = lambda w: F.aggregate(F.filter(tokens, lambda t: t.bitwiseAND(PARITY - 1) == w), F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))
    return F.array(*[word(w) for w in range(PARITY)])


def _node() -> Column:
    return F.when(F.col("sub") == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "sub")).alias("doc_id")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, levels: int = LEVELS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id that links lead to, itself included).

    1. Each document's set is sketched: size, a 128-bit checksum of the set, and a prefix in hash order that is lengthened
       by a twentieth of the set and must then share as many tokens with other sets, or the document has no partner.
       Equal sets are one from here on.
    2. The documents left are ordered by true rarity; a token of one set alone goes first and needs no posting.
    3. Each document picks its prefix extension by the estimated cost of its candidates, and demands one more shared token
       for each step.
    4. Posting lists are first linked through one document each, which joins dense groups without listing their pairs; then
       every remaining pair of a list that lies in two classes is counted and verified. Nothing is capped.

    A null or empty text, or one without words, has no shingles and no links; a row without an id has no links and a null
    component; repeated rows (one id, one text) share theirs; texts that share an id are documents of their own; very long
    texts are handled whole, one at a time; an empty table gives an empty one; other columns are not looked at.
    """
    docs = keyed(documents_of(docs, text_col, id_col))
    several = shared_ids(docs, "shingle")
    if several is not None:
        # A hash stands for each text of a shared id until the components are known.
        docs = told_apart(docs, several.filter(F.col("doc_id") != NO_ID))
        names = stage(docs.select(_node().alias("node"), "doc_id").distinct(), "shingle-names")
        docs = docs.select(_node(), "text")
    sketched = stage(docs.mapInArrow(_sketches(k, similarity), "doc_id long, n long, s1 long, s2 long, need long, prefix array<long>"), "shingle-sketches")
    sketch = sketched.filter((F.col("n") > 0) & (F.col("doc_id") != NO_ID))
    token = sketch.select("doc_id", "s1", "need", F.explode("prefix").alias("h"))
    shared = token.groupBy("h").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).filter("a != b").select("h")
    hits = token.select("doc_id", "need", "h").join(shared, "h").groupBy("doc_id").agg(F.countDistinct("h").alias("hits"), F.max("need").alias("need"))
    light = sketched.select("doc_id", "n", "s1", "s2")
    groups = light.filter((F.col("n") > 0) & (F.col("doc_id") != NO_ID)).groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = stage(light.join(groups, ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id") != NO_ID, F.coalesce("rep", "doc_id")).alias("rep")), "shingle-classes")
    alive = stage(hits.filter("hits >= need").select("doc_id").join(classes.filter("doc_id = rep").select("doc_id").distinct(), "doc_id"), "shingle-alive")
    unstage(sketched)

    rows = docs.join(alive, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_shingles(k), "doc_id long, n long, h long")
    rows = stage(rows, "shingle-rows")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = rows.join(often, "h").groupBy("doc_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("ranked"))
    least = F.ceil(F.col("n") * similarity / 100).cast("int")
    sets = ranked.withColumn("base", F.size("ranked") - least + 1).filter("base > 0")
    # Cost of level l: postings read, and as many verifications as candidates with l shared tokens can use them up for.
    cost = [F.expr(f"aggregate(slice(ranked, 1, base + {i}), 0D, (s, t) -> s + t.df)") * (1 + F.col("n") / F.lit(i + 1.0)) for i in range(levels)]
    sets = sets.withColumn("level", F.array_position(F.array(*cost), F.array_min(F.array(*cost))).cast("int"))
    sets = stage(sets.select("doc_id", "n", "base", "level", F.expr("transform(ranked, t -> t.h)").alias("tokens")), "shingle-sets")
    unstage(rows)
    # The index holds prefixes of the longest level, since a probe of any level looks into prefixes of its own.
    postings = stage(
        sets.select("doc_id", "n", "base", "level", F.size("tokens").alias("m"), "tokens", F.posexplode(F.expr(f"slice(tokens, 1, base + {levels - 1})")).alias("i", "h"))
        .withColumn("before", F.expr(f"slice(tokens, greatest(1, i + 1 - {LOOKBACK}), least(i, {LOOKBACK}))"))
        .select("doc_id", "n", "base", "level", "h", "i", (F.col("m") - F.col("i")).alias("rest"), "before"),
        "shingle-postings",
    )
    posting = postings.filter("i < base")

    # Length filter; then, with the overlap that these two sizes need, the prefix of this very pair and the positional filter.
    sized = 100 * F.least("nx", "ny") >= similarity * F.greatest("nx", "ny")
    overlap = F.ceil((F.col("nx") + F.col("ny")) * similarity / (100 + similarity))
    placed = F.least("ix", "iy") + F.least("rx", "ry") >= overlap
    found = None
    for turn in range(PIVOT_ROUNDS):
        have = posting if found is None else posting.join(found.select(F.col("a").alias("doc_id"), "b"), "doc_id", "left")
        have = have.withColumn("part", F.col("doc_id") if found is None else F.coalesce("b", "doc_id"))
        if found is not None:  # lists that lie in one class are settled
            open_ = have.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("h")
            have = have.join(open_, "h")
        pivot = have.groupBy("h").agg(F.min_by(F.struct("doc_id", "n", "part", "i", "rest"), F.xxhash64(F.lit(turn), "doc_id")).alias("v"))
        pairs = have.join(pivot, "h").filter("part != v.part").select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("rest").alias("rx"), F.col("v.doc_id").alias("y"), F.col("v.n").alias("ny"), F.col("v.i").alias("iy"), F.col("v.rest").alias("ry"))
        new = _verified(pairs.filter(sized & placed).select("x", "y").distinct(), sets, similarity)
        # What was found keeps its parts together, so that old links need not be looked at again.
        before, found = found, components(new if found is None else found.select("a", "b").unionByName(new))
        if before is not None:
            unstage(before)
    have = postings.join(found.select(F.col("a").alias("doc_id"), "b"), "doc_id", "left").withColumn("part", F.coalesce("b", "doc_id"))
    open_ = have.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("h")
    have = stage(have.join(open_, "h").select("h", "doc_id", "n", "base", "level", "part", "i", "rest", "before"), "shingle-open")
    opened = have
    signed_ = sets.join(have.select("doc_id").distinct(), "doc_id").select("doc_id", _parity(F.col("tokens")).alias("sign"))
    have = have.join(signed_, "doc_id")
    fields = (("doc_id", ""), ("n", "n"), ("part", "p"), ("i", "i"), ("rest", "r"), ("before", "b"), ("sign", "g"), ("base", "o"))
    side = lambda c, *more: have.select("h", *more, *[F.col(x).alias(f"{y}{c}") for x, y in fields])
    probe, index = side("x", "level").filter(F.col("ix") < F.col("ox") + F.col("level") - 1), side("y")
    # x asks for as many shared tokens as its level says, in prefixes lengthened to it: the pair is listed at the posting that
    # is the last of so many, and behind it the overlap must still be possible. Where a posting remembers too few of the
    # rarer tokens to count them all, it is listed sooner.
    both = F.size(F.array_intersect("bx", "by"))
    cut = (F.col("ix") > LOOKBACK) | (F.col("iy") > LOOKBACK)
    enough = (both == F.col("level") - 1) | (cut & (both < F.col("level") - 1))
    within = (F.col("iy") < F.col("oy") + F.col("level") - 1) & (F.least("rx", "ry") + F.col("level") - 1 >= overlap)
    differ = sum((F.bit_count(F.col("gx")[k].bitwiseXOR(F.col("gy")[k])) for k in range(1, PARITY)), F.bit_count(F.col("gx")[0].bitwiseXOR(F.col("gy")[0])))
    alike = differ <= F.col("ix") + F.col("rx") + F.col("iy") + F.col("ry") - 2 * overlap
    pairs = probe.join(index, (probe.h == index.h) & (F.col("y") < F.col("x")) & (F.col("px") != F.col("py")) & sized & within & alike & enough).select("x", "y").distinct()
    before, found = found, components(found.select("a", "b").unionByName(_verified(pairs, sets, similarity)))
    unstage(before, alive, sets, postings, opened)
    out = classes.join(found.select(F.col("a").alias("rep"), "b"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("b", "rep").alias("component_id"))
    if several is not None:
        known = out.withColumnRenamed("doc_id", "node").join(names, "node")
        least = known.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        out = known.join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return unkeyed(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
