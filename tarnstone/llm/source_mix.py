"""Operator 11, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnstone.llm.common import read_table, stage, unstage
from tarnstone.llm.quality_rules import words_column

#: Weights of the sources in code-point order, repeating; words of the mix for each word of the input; how often a word may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 11
#: Words of a block; fewer where the whole input has under BLOCKS blocks of that many.
BLOCK_WORDS = 128
BLOCKS = 1 << 14
#: A source of n words has sqrt(n / SHARD_UNIT) shards, so that neither their number nor their size grows as fast as it.
SHARD_UNIT = 1024
#: Sources up to which they are broadcast.
BROADCAST_SOURCES = 50_000


def digits(*said: Column) -> Column:
    """A number below 2^60 from the MD5 sum of texts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *said)), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Staged df with rank, from 0 on, in a total order; rows are sorted in ranges, and no task sees them all."""
    ranges = stage(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    out = stage(ranges.join(F.broadcast(before), "range").withColumn("rank", within + F.col("before")).drop("range", "before"), name)
    unstage(ranges)
    return out


def sized(docs: DataFrame, text_col: str, source_col: str | None, id_col: str, seed: int) -> DataFrame:
    """doc_id, source, size, key, text: key is the seeded place of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    key = digits(F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("")), F.md5(text))
    return docs.select(doc.alias("doc_id"), source.alias("source"), F.size(words_column(text)).cast("long").alias("size"), key.alias("key"), text.alias("text"))


def level(sources: DataFrame, budget: float, most: float) -> float:
    """The words a unit of weight gets: what sources at their most leave over is dealt to the others again, until none is above.

    sources: weight, source_size. The driver sees two sums a turn; a turn fixes one source at least.
    """
    now = None
    while True:
        full = F.lit(False) if now is None else F.col("weight") * F.lit(now) > F.col("source_size") * F.lit(float(most))
        sums = sources.agg(F.sum(F.when(full, F.col("source_size") * F.lit(float(most))).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight").cast("double"))).alias("open")).first()
        new = (budget - sums.full) / sums.open if sums.open else now
        if new == now:
            return now or 0.0
        now = new


def seats(votes: Column, total_votes: Column, places: Column, parties: Column, cap: Column) -> tuple[Column, Column]:
    """(sure, possible): bounds of a party's seats by the method of highest quotients votes / (2 seat - 1).

    With a divisor off by half the number of parties in all, rounded shares add up to no more than there are places on one
    side and to no less on the other, so the quotients of two seats a party or so remain to be compared.
    """
    share = F.when(total_votes > 0, votes * places / total_votes).otherwise(0.0)
    off = F.when(places > 0, parties / (2.0 * places)).otherwise(0.0)
    sure = F.least(cap, F.greatest(F.lit(0), F.ceil(share * (1 - off) - 0.5))).cast("long")
    return sure, F.least(cap, F.floor(share * (1 + off) + 0.5) + 1).cast("long")


def quotas_of_sources(sources: DataFrame, most: int) -> DataFrame:
    """Staged number, quota: blocks of each source. sources: number, source_size, target, blocks."""
    full = F.col("target") >= F.col("source_size") * most
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    rows = stage(sources.select("number", "blocks", full.alias("full"), votes.alias("votes")), "mix-votes")
    sums = rows.filter("NOT full").agg(F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("n")).first()
    places = round(sums.votes or 0.0)
    sure, possible = seats(F.col("votes"), F.lit(sums.votes or 0.0), F.lit(float(places)), F.lit(float(sums.n)), F.col("blocks") * most)
    bounds = rows.select("number", "votes", F.when(F.col("full"), F.col("blocks") * most).otherwise(sure).alias("sure"), F.when(F.col("full"), F.col("blocks") * most).otherwise(possible).alias("possible"), "full")
    left = places - (bounds.filter("NOT full").agg(F.sum("sure")).first()[0] or 0)
    claims = bounds.filter("possible > sure").select("number", "votes", F.explode(F.sequence(F.col("sure") + 1, "possible")).alias("seat")).select("number", (F.col("votes") / (2.0 * F.col("seat") - 1)).alias("quotient"))
    won = ranked(claims, "mix-claims", F.col("quotient").desc(), F.col("number")).filter(F.col("rank") < left).groupBy("number").agg(F.count(F.lit(1)).alias("won"))
    return bounds.join(won, "number", "left").select("number", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def quotas_of_shards(shards: DataFrame, most: int) -> DataFrame:
    """number, shard, blocks, quota: a source's quota dealt to its shards by their blocks. shards: number, shard, blocks, places."""
    own = Window.partitionBy("number")
    summed = shards.withColumn("all", F.sum("blocks").over(own)).withColumn("n", F.count(F.lit(1)).over(own))
    sure, possible = seats(F.col("blocks").cast("double"), F.col("all").cast("double"), F.col("places").cast("double"), F.col("n").cast("double"), F.col("blocks") * most)
    bounds = stage(summed.select("number", "shard", "blocks", "places", sure.alias("sure"), possible.alias("possible")), "mix-shards")
    left = bounds.groupBy("number").agg((F.first("places") - F.sum("sure")).alias("left"))
    claims = bounds.filter("possible > sure").select("number", "shard", "blocks", F.explode(F.sequence(F.col("sure") + 1, "possible")).alias("seat")).select("number", "shard", (F.col("blocks") / (2.0 * F.col("seat") - 1)).alias("quotient"))
    order = Window.partitionBy("number").orderBy(F.col("quotient").desc(), "shard")
    won = claims.withColumn("rank", F.row_number().over(order)).join(left, "number").filter("rank <= left").groupBy("number", "shard").agg(F.count(F.lit(1)).alias("won"))
    return bounds.join(won, ["number", "shard"], "left").select("number", "shard", "blocks", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str | None = "source", id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block_words: int = BLOCK_WORDS, texts: bool = False) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, spans, and with texts=True the mixed text.

    The mix has `share` times the words of the input. Sources weigh `weights` in code-point order, null last; a source's
    target stops at `most` times its size, and what is over goes to the others by weight. Every source's documents are dealt
    to shards by a seeded hash, laid end to end in its order and cut into blocks of equal words (a shard's last may be
    shorter). Sources get blocks by highest quotients, and a source's shards get theirs likewise; inside a shard, blocks are
    taken at a seeded offset in equal steps, `most` times at most. spans: (first, stop, times), words of the document from
    first to stop - 1. taken: words times their number.

    Null and empty texts have size 0 and give nothing; repeated rows are taken each for itself; documents without an id,
    or that share one, are told apart by their texts; very long texts are cut between words; sources of no words have target
    0; other columns are not looked at; an empty table gives an empty one. Nothing depends on partitions or order of rows.
    """
    rows = sized(docs, text_col, source_col, id_col, seed)
    rows = stage(rows if texts else rows.drop("text"), "mix-sizes")
    sources = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "mix-sources", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.select("source", "source_size", F.col("rank").alias("number"), weight.alias("weight"))
    seen = sources.agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("n")).first()
    total = seen.words or 0
    lam = level(sources, share * total, most)
    target = F.least(F.col("weight") * F.lit(lam), F.col("source_size") * F.lit(float(most)))
    sources = sources.select("source", "source_size", "number", target.alias("target"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / SHARD_UNIT))).cast("long").alias("n_shards"))
    block = min(block_words, max(1, total // BLOCKS))

    known = F.broadcast(sources) if seen.n <= BROADCAST_SOURCES else sources
    placed = rows.join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", F.pmod("key", "n_shards"))
    shards = stage(placed.groupBy("number", "shard").agg(F.sum("size").alias("words")).select("number", "shard", F.ceil(F.col("words") / block).cast("long").alias("blocks")), "mix-blocks")
    blocks = shards.groupBy("number").agg(F.sum("blocks").alias("blocks"))
    quotas = quotas_of_sources(sources.join(blocks, "number").select("number", "source_size", "target", "blocks"), most)
    dealt = quotas_of_shards(shards.join(quotas.withColumnRenamed("quota", "places"), "number"), most)
    step = F.when(F.col("blocks") > 0, F.pmod(digits(F.lit(str(seed)), F.col("number").cast("string"), F.col("shard").cast("string")), "blocks")).otherwise(0)
    dealt = stage(dealt.withColumn("begin", step), "mix-quotas")

    before = Window.partitionBy("number", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.join(dealt, ["number", "shard"]).withColumn("at", F.sum("size").over(before) - F.col("size"))
    spans = F.expr(f"""
        filter(transform(if(size > 0, sequence(at div {block}, (at + size - 1) div {block}), array()), j -> named_struct(
            'first', greatest(at, j * {block}) - at, 'stop', least(at + size, (j + 1) * {block}) - at,
            'times', quota div blocks + ((j + 1 + begin) * (quota % blocks)) div blocks - ((j + begin) * (quota % blocks)) div blocks)), s -> s.times > 0)""")
    out = at.withColumn("spans", spans)
    columns = ["doc_id", "source", "size", "source_size", "target", F.expr("aggregate(spans, 0L, (t, s) -> t + (s.stop - s.first) * s.times)").alias("taken"), "spans"]
    if texts:
        words = words_column(F.col("text"))
        columns.append(F.array_join(F.flatten(F.transform("spans", lambda s: F.flatten(F.array_repeat(F.slice(words, (s["first"] + 1).cast("int"), (s["stop"] - s["first"]).cast("int")), s["times"].cast("int"))))), " ").alias("text"))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
