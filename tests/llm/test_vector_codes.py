"""Operator 12 against plain Lloyd rounds over all entries."""

import hashlib

import numpy as np
import pytest

from tarnstone.llm.vector_codes import Tree, encode


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label) without ids that repeat -> id: (code, error, label_error), digest."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    x = np.array([[int(np.floor(1024 * float(np.float32(v)))) for v in r[1]] for r in kept], np.int64)
    pieces = np.split(x, parts, axis=1)
    codes, errors, numbers = [], 0, []
    for piece in pieces:
        book = piece[:entries].copy()
        for turn in range(rounds + 1):
            d = ((piece[:, None, :] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if turn < rounds:
                for e in range(len(book)):
                    if (near == e).any():
                        book[e] = piece[near == e].sum(0) // (near == e).sum()
        codes.append(near)
        errors = errors + d.min(1)
        numbers += book.ravel().tolist()
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + int(e)
    out = {r[0]: ("".join(f"{c[i]:02x}" for c in codes), int(errors[i]), by[r[2]]) for i, r in enumerate(kept)}
    return out, hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def check(spark, rows, schema="vec_id long, embedding array<float>, label int", **k):
    want, sha = plain(rows, **k)
    got = encode(spark.createDataFrame(rows, schema), **k).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_filtering_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for n, w, k, spread in ((1, 3, 1, 2), (40, 2, 9, 2), (700, 3, 30, 4), (3000, 4, 64, 40), (2000, 1, 50, 60)):
        points, book = rng.integers(-spread, spread, (n, w)), rng.integers(-spread, spread, (k, w))
        tree = Tree(points)
        codes, total, count = tree.filtered(book)
        want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        got = np.empty(n, np.int64)
        got[tree.perm] = codes
        assert (got == want).all()
        assert (count == np.bincount(want, minlength=k)).all()
        assert all((total[e] == points[want == e].sum(0)).all() for e in range(k))


def test_whole_subtrees_are_assigned():
    points = np.concatenate([np.full((2000, 2), 0), np.full((2000, 2), 1000)])
    tree = Tree(points)
    tree.points = tree.points * 0 + 10**6  # never looked at: the boxes settle all nodes
    _, total, count = tree.filtered(np.array([[1, 1], [999, 999]]))
    assert count.tolist() == [2000, 2000] and total.tolist() == [[0, 0], [2_000_000, 2_000_000]]


@pytest.mark.parametrize("n", [1, 3, 300, 2000])
def test_rounds(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(int(i) * 7 - 50, [float(np.float32(v)) for v in centres[i % 12] + rng.normal(0, 0.2, 8)], None if i % 5 == 0 else i % 3) for i in range(n)]
    check(spark, rows)


def test_small_codebooks_and_copies(spark):
    rows = [(i, [float(i % 3), -1.5, 0.25 * (i % 2), 7.0], i % 2) for i in range(200)]
    check(spark, rows, entries=5, rounds=3)
    check(spark, rows, parts=2)


def test_bad_rows_go(spark):
    ok = [(i, [0.1 * i, -0.3, 2.0, float(i % 4)], 1) for i in range(20)]
    bad = [(-1, None, 1), (-2, [None, 1.0, 1.0, 1.0], 1), (-3, [float("nan"), 1.0, 1.0, 1.0], 2), (-4, [float("inf"), 1.0, 1.0, 1.0], 2), (-5, [1.0, 1.0, 1.0, float("-inf")], 2)]
    check(spark, ok + bad)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label string, code string, error long"
    df = spark.createDataFrame([(1, [1.0] * 4, "a", "x", 1), (1, [1.0] * 4, "a", "x", 1), (1, [3.0] * 4, "b", "x", 1), (None, [2.0] * 4, None, "x", 1), (2, [1.0], "a", "x", 1), (3, [1e30] * 4, None, "x", 1)], schema)
    got = sorted(encode(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.code))
    # Starts: id 1 (its least vector), 3, and the row without an id; the vector of another length goes.
    assert [r.vec_id for r in got] == [1, 1, 1, 3, None]
    assert got[0].code == got[1].code == "00000000" and got[3].code == "01010101"
    assert encode(df.limit(0)).count() == 0
    assert encode(df.select("vec_id", "embedding"), label_col=None).count() == 5
    odd = encode(spark.createDataFrame([(1, [1.0] * 6), (2, [])], "vec_id long, embedding array<double>"), label_col=None).collect()
    assert [(r.vec_id, r.code, r.error) for r in odd] == [(1, "00000000", 0)]
    empty = encode(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<double>"), label_col=None).collect()
    assert {(r.code, r.error) for r in empty} == {("00000000", 0)}
