"""Operator 11 against targets worked out one by one, quotas dealt seat by seat, and its DuckDB statement."""

import os
import random
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connection  # noqa: E402

from tarnstone.llm.oracles import ORACLE_SQL  # noqa: E402
from tarnstone.llm.source_mix import mix, query, quotas_of_shards, quotas_of_sources, ranked  # noqa: E402


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: by source, in order."""
    open_, left, out = set(range(len(sizes))), share * sum(sizes), {}
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        full = {i for i in open_ if weights[i % len(weights)] * unit > most * sizes[i]}
        if not full:
            return out | {i: weights[i % len(weights)] * unit for i in open_}
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def dealt(votes, caps, places):
    """Seat by seat to the highest quotient."""
    have = [0] * len(votes)
    for _ in range(places):
        i = max((i for i in range(len(votes)) if have[i] < caps[i]), key=lambda i: (votes[i] / (2 * have[i] + 1), -i))
        have[i] += 1
    return have


def check(rows, sizes, tolerance):
    """rows: of mix(); sizes: words by source, in order."""
    want = targets([n for _, n in sizes])
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum((s.stop - s.first) * s.times for s in r.spans)
        assert all(0 <= s.first < s.stop <= r.size and 1 <= s.times <= 2 for s in r.spans)
        taken[r.source] += r.taken
    for i, (source, n) in enumerate(sizes):
        mine = [r for r in rows if r.source == source]
        assert all(r.source_size == n and r.target == pytest.approx(want[i]) for r in mine)
        assert abs(taken[source] - want[i]) <= tolerance, (source, taken[source], want[i])


def corpus(sizes, seed=1):
    rnd, rows = random.Random(seed), []
    for source, n in sizes:
        while n > 0:
            k = min(n, rnd.choice([1, 3, 40, 200, 3000]))
            rows.append((len(rows), " ".join(rnd.choices(["a", "bb", "été"], k=k)), source))
            n -= k
    rnd.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, source string"


def test_targets_are_met(spark):
    sizes = [("A", 30_000), ("a", 500), ("b", 2_000), ("c", 20_000), ("é", 7), ("中", 4_000), (None, 900)]
    rows = mix(spark.createDataFrame(corpus(sizes), SCHEMA)).collect()
    check(rows, sizes, 40)


def test_a_hot_source_and_long_blocks(spark):
    sizes = [("a", 400_000), ("b", 90_000), ("c", 300_000)]
    df = spark.createDataFrame(corpus(sizes), SCHEMA)
    rows = mix(df).collect()
    check(rows, sizes, 3_000)
    again = mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    other = mix(df, seed=12).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) != sorted((r.doc_id, r.taken) for r in other)


def test_sources_at_their_most(spark):
    # All sources but the first are full at twice their size.
    sizes = [("a", 10_000), ("b", 10), ("c", 10), ("d", 10)]
    check(mix(spark.createDataFrame(corpus(sizes), SCHEMA)).collect(), sizes, 2)


@pytest.mark.parametrize("seed", range(3))
def test_quotas_seat_by_seat(spark, seed):
    rnd = random.Random(seed)
    blocks = [rnd.choice([0, 1, 2, 7, 50, 900]) for _ in range(12)]
    places = rnd.randrange(2 * sum(blocks) + 1)
    df = spark.createDataFrame([(5, i, b, places) for i, b in enumerate(blocks)], "number long, shard long, blocks long, places long")
    got = {r.shard: r.quota for r in quotas_of_shards(df, 2).collect()}
    assert [got[i] for i in range(12)] == dealt(blocks, [2 * b for b in blocks], places)
    targets_ = [b * rnd.choice([0.3, 1.1, 1.9, 2.0]) for b in blocks]
    df = spark.createDataFrame([(i, 100 * b, 100.0 * t, b) for i, (b, t) in enumerate(zip(blocks, targets_, strict=True))], "number long, source_size long, target double, blocks long")
    got = {r.number: r.quota for r in quotas_of_sources(df, 2).collect()}
    part = [i for i, (b, t) in enumerate(zip(blocks, targets_, strict=True)) if t < 2 * b]
    votes = [100.0 * targets_[i] * blocks[i] / (100 * blocks[i]) for i in part]
    want = dict(zip(part, dealt(votes, [2 * blocks[i] for i in part], round(sum(votes))), strict=True))
    assert got == {i: want.get(i, 2 * blocks[i]) for i in range(12)}


def test_ranks(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    assert sorted((r.x, r["rank"]) for r in ranked(df, "t", F.col("x")).collect()) == [(i, i) for i in range(1000)]


def test_texts(spark):
    df = spark.createDataFrame([(1, " one two\nthree ", "a"), (2, "four", "b")], SCHEMA)
    rows = {r.doc_id: r for r in mix(df, texts=True).collect()}
    # 6 words by 3:1; b stops at 2.
    assert rows[1].taken == 4 or rows[1].taken == 5
    assert len(rows[1].text.split(" ")) == rows[1].taken and set(rows[1].text.split(" ")) <= {"one", "two", "three"}


def test_edges(spark):
    rows = [(1, None, "a", 9), (2, "", "a", 9), (None, "x y z", None, 9), (None, "x y z", None, 9), (3, "p q", "b", 9), (3, "r s t", "b", 9), (3, "p q", "b", 9), (4, "  ", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mix(df).collect()
    check(out, [("a", 0), ("b", 7), (None, 6)], 1)
    assert len(out) == len(rows)
    assert mix(df.limit(0)).count() == 0
    assert {(r.target, r.taken) for r in mix(df.filter("doc_id < 3")).collect()} == {(0.0, 0)}
    assert sum(r.taken for r in mix(df, source_col=None).collect()) in (19, 20)


def test_statement(spark, sf):
    assert compare(spark, connection(sf), sf, "op11_source_mix", query, ORACLE_SQL["op11_source_mix"]) == ""
