"""Operator 13 against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnstone.llm.spelling import Wavelet, near_pairs, runs_of, variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        count[w], form[w] = len(others), best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n.get(form[w])))
    return out


def check(spark, rows, **k):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(spark.createDataFrame(rows, "doc_id long, text string"), **k).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    return got


def test_reports_all_points():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 256, 257):
        values = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 300) for _ in range(4))
        q, v = Wavelet(values).report(a, b, c, d)
        want = sorted((k, int(x)) for k in range(300) for x in values[a[k] : b[k]] if c[k] <= x < d[k])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=6), min_size=1, max_size=30))
def test_pairs(words):
    words = sorted(words)
    own = np.array([i for i, w in enumerate(words) if len(w) == 5], np.int64)
    halves = [np.repeat(own, 2), np.tile([0, 2], len(own)), np.tile([2, 5], len(own))]
    x, y = near_pairs([w.encode("latin-1") for w in words], 5, *halves)
    want = sorted((a, b) for a in range(len(words)) for b in range(len(words)) if near(words[a], words[b]) and min(len(words[a]), len(words[b])) == 5)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_runs():
    assert runs_of("Été-ÉTÉ a×b 中ß_x") == Counter({"Été".encode("latin-1"): 1, "ÉtÉ".encode("latin-1"): 1, "a×b".encode("latin-1"): 1, "ß".encode("latin-1"): 1, b"x": 1})
    text = "word " * 500_000
    assert runs_of(text) == Counter({b"word": 500_000})


def corpus(seed, n_words, letters, sizes):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices(letters, k=rnd.choice(sizes))) for _ in range(n_words)]
    for w in words[: n_words // 2]:
        i = rnd.randrange(len(w))
        words.append(rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + w[i] + w[i:], w + rnd.choice(letters)]))
    return [(i, " ".join(rnd.choice(words) for _ in range(200))) for i in range(40)]


def test_against_all_pairs(spark):
    check(spark, corpus(1, 150, "abcdeéÀZ", [5, 6, 7, 8]))
    check(spark, corpus(2, 60, "ab", [4, 5, 6]))


def test_groups_that_are_halved(spark):
    rows = corpus(3, 120, "abc", [5, 6, 9])
    assert set(check(spark, rows, group_letters=40, shard_letters=500)) == set(check(spark, rows))


def test_table(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "colour color colour color"), (3, "colour colour color colour"), (3, "colour colour color colour"), (None, "colours " * 9), (5, "z" * 30_000 + " " + ("z" * 29_999 + " ") * 3), (6, ("z" * 30_000 + " ") * 3)]
    check(spark, rows)
    df = spark.createDataFrame([(1, "colour " * 3, "x", 2, True)], "doc_id long, text string, word string, n int, class boolean")
    assert [(r.word, r.n) for r in variants(df).collect()] == [("colour", 3)]
    assert variants(df.limit(0)).count() == 0
