"""Operator 1 against brute force over all pairs of lines."""

import hashlib
import random
import re

import pytest

from tarnstone.llm import line_dedup
from tarnstone.llm.line_dedup import dedup_lines, line_report

SCHEMA = "doc_id long, text string, line_no string, n long"


def brute(rows, similarity=80):
    seen, kept = [], {}
    for d, t in sorted({d: t for d, t in rows}.items()):
        out = []
        for line in (t or "").split("\n"):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not s or not any(100 * len(s & o) >= similarity * len(s | o) for o in seen):
                out.append(line)
            if s:
                seen.append(s)
        kept[d] = out
    return kept


def corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["é", "漢字", "The"]
    pool = [rnd.choices(vocab, k=rnd.choice([1, 2, 3, 4, 5, 6, 9, 12, 20, 40])) for _ in range(80)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(0, 7)):
            line = list(rnd.choice(pool)) if rnd.random() < 0.7 else rnd.choices(vocab, k=rnd.randint(1, 30))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                r = rnd.random()
                if r < 0.4:
                    line[rnd.randrange(len(line))] = rnd.choice(vocab)
                elif r < 0.7 or len(line) == 1:
                    line.append(rnd.choice(vocab))
                else:
                    line.pop()
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n \n\t"), (103, "a\na\r\n a\n"), rows[7]]


def test_lines(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA)
    got = line_report(df).collect()
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 30
    for r in got:
        lines = want[r.doc_id]
        total = len((dict(rows)[r.doc_id] or "").split("\n"))
        assert r.n_removed == total - len(lines), r.doc_id
        assert r.kept_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest(), r.doc_id
    kept = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert kept[100].text is None and kept[3].line_no == "x" and kept[3].n == 5
    assert all(kept[d].text == "\n".join(want[d]) for d in want if d != 100)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_report(none).count() == 0 and dedup_lines(none).count() == 0
    assert dedup_lines(spark.createDataFrame([(None, "a b c d", "", 0), (3, "a b c d\nx", "", 0)], SCHEMA)).count() == 2


@pytest.mark.parametrize("similarity", [100, 67, 30])
def test_other_similarities(spark, similarity):
    rows = corpus()
    want = brute(rows, similarity)
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA), similarity).collect()}
    assert all(kept[d] == "\n".join(want[d]) for d in want if d != 100)


@pytest.mark.parametrize("similarity", [80])
def test_pairs_of_frequent_tokens(spark, monkeypatch, similarity):
    monkeypatch.setattr(line_dedup, "FREQUENT", 3)
    rnd = random.Random(4)
    rows = [*corpus(), *[(200 + i, f"all these lines have the same words but number {i} and {rnd.choice('xyz')}") for i in range(40)]]
    want = brute(rows, similarity)
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA), similarity).collect()}
    assert all(kept[d] == "\n".join(want[d]) for d in want if d != 100)


def test_long_lines(spark):
    rnd = random.Random(5)
    line = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.sample(line, 300 - rnd.randint(0, 60)) + [f"u{i}{k}" for k in range(rnd.randint(0, 25))])) for i in range(30)]
    want = brute(rows)
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)).collect()}
    assert 0 < sum(not t for t in kept.values()) < 30 and all(kept[d] == "\n".join(want[d]) for d in want)


@pytest.mark.parametrize("number", [None, 1])
def test_texts_that_share_an_id(spark, number):
    texts = ["alpha beta gamma delta\nunique words stand here now", "other first line of text\nalpha beta gamma delta"]
    got = [r.text for r in dedup_lines(spark.createDataFrame([(number, t, "", 0) for t in [*texts, texts[0]]], SCHEMA)).collect()]
    assert sorted(got) in (sorted([texts[0], "other first line of text", texts[0]]), sorted([texts[1], *["unique words stand here now"] * 2]))


def test_emptied_texts(spark):
    rows = [(1, "a b c d e\nf g h i j"), (2, "f g h i j\n\na b c d e"), (3, ""), (4, None), (5, " \n"), (6, "a b c d e\nnew")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), drop_emptied=True).collect()}
    assert got == {1: "a b c d e\nf g h i j", 3: "", 4: None, 5: " \n", 6: "new"}


def test_pivots_of_crowds_only(spark, monkeypatch):
    """Sets are compared with pivots only where many share a sampled token; the join finds the others, with the same result."""
    rows = [(i, f"all of these lines stand here in one crowd and end by {i % 50}") for i in range(150)] + [(500 + i, f"two of a kind number {i} are few words") for i in (1, 1, 2, 3)]
    df = spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)
    docs = df.selectExpr("doc_id", "xxhash64(text) AS tkey", "text")
    sets = line_dedup.line_sets(docs, 80).selectExpr("doc_id AS sid", "*", "1L AS copies")
    assert line_dedup._near_pivots(sets.filter("doc_id >= 500"), 80).count() == 0
    assert line_dedup._near_pivots(sets.filter("doc_id < 500"), 80).count() >= 100
    want = brute(rows)
    assert all(r.text == "\n".join(want[r.doc_id]) for r in dedup_lines(df).collect())


def test_signature_levels(spark):
    """sign and half hold the tokens of disjoint ranges of levels, and no set that is alike is told apart by them."""
    rows = corpus()
    docs = spark.createDataFrame([(d, t or "", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, tkey long")
    levels, (low, high) = line_dedup.rarity(docs)
    assert 0 <= low <= high <= line_dedup.LEVELS
    got = line_dedup.line_sets(docs, 80).collect()
    words = {(i, k): set(re.findall(r"[^\x20\x09-\x0D]+", line)) for i, (_, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n"))}
    assert all(r.n == len(words[r.tkey, r.line_no]) for r in got) and any(r.sign for r in got) and any(r.half for r in got)
    bits = lambda v: bin(v & (1 << 64) - 1).count("1")
    for x in got[:60]:
        for y in got:
            assert bits(x.sign ^ y.sign) + bits(x.half ^ y.half) <= len(words[x.tkey, x.line_no] ^ words[y.tkey, y.line_no])
