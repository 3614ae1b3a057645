"""Operators 3 and 8 against brute force."""

import hashlib
import os
import random
import re

import pytest

from tarnstone.llm.suffix_dedup import dedup_suffixes, kasai, suffix_array
from tarnstone.llm.window_dedup import dedup_windows

SCHEMA = "doc_id long, text string, n_removed int, mhash string"


def corpus(seed=5, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "é", "漢字", "x"] + [f"w{i}" for i in range(30)]
    passages = [" ".join(rnd.choices(vocab, k=rnd.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(vocab, k=rnd.randint(1, 40))))
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "ab " * 300), (104, rows[3][1]), (105, rows[3][1]), (106, "z " * 30)]
    rows.append(rows[5])
    return rows


def windows(seq, w):
    return [seq[i : i + w] for i in range(len(seq) - w + 1)]


def brute(rows, cut, w):
    """Units removed from each row; equal rows are one document."""
    first = {}
    docs = sorted({d: t or "" for d, t in rows}.items())
    out = {}
    for d, t in docs:
        seq = cut(t)
        gone = [False] * len(seq)
        for i, x in enumerate(windows(seq, w)):
            if x in first:
                gone[i : i + w] = [True] * w
            first.setdefault(x, (d, i))
        out[d] = (seq, gone)
    return out


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_suffixes(spark, shard):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA)
    want = brute(rows, lambda t: t.encode(), 40)
    got = dedup_suffixes(df, 40, 10, shard).collect()
    assert len(got) == len(rows)
    for r in got:
        seq, gone = want[r.doc_id]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(seq, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(seq), sum(gone), spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_windows(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA)
    want = brute(rows, lambda t: tuple(re.findall(r"[^\x20\x09-\x0D]+", t)), 9)
    got = dedup_windows(df, 9, 3).collect()
    assert len(got) == len(rows)
    for r in got:
        seq, gone = want[r.doc_id]
        kept = " ".join(b for b, g in zip(seq, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(seq), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedup_suffixes(none).count() == 0 and dedup_windows(none).count() == 0
    long = "one two three four five six seven eight nine ten " * 4
    df = spark.createDataFrame([(None, long, 0, ""), (None, None, 0, ""), (7, long, 0, "")], SCHEMA)
    assert {r.doc_id: r.n_removed for r in dedup_suffixes(df).collect() if r.n_bytes}[7] == len(long)
    assert {r.doc_id: r.n_removed for r in dedup_windows(df).collect() if r.n_words}[7] == 40


def test_suffix_array_order():
    import numpy as np

    rnd = random.Random(2)
    for text in [b"", b"a", b"banana", b"a" * 50, bytes(rnd.choices(b"ab\x00", k=400))]:
        data = np.frombuffer(text, np.uint8)
        order, _ = suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = kasai(data, order)
        for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            assert common[j] == len(os.path.commonprefix([text[i:], text[j:]]))


@pytest.mark.parametrize("number", [None, 4])
def test_texts_that_share_an_id(spark, number):
    half = " ".join(f"w{i}" for i in range(60))
    texts = [half + " and " + half, " ".join(f"v{i}" for i in range(160)), half]
    df = spark.createDataFrame([(number, t, 0, "") for t in [*texts, texts[1]]], SCHEMA)
    for rows, size, least in ((dedup_suffixes(df).collect(), "n_bytes", len(half)), (dedup_windows(df).collect(), "n_words", 60)):
        gone = {r[size]: r.n_removed for r in rows}
        sizes = [len(t) if size == "n_bytes" else len(t.split()) for t in texts]
        assert len(rows) == 4 and gone[sizes[1]] == 0
        # Of the other two texts, the one with the greater hash loses what it shares, and the longer one its second half.
        assert gone[sizes[0]] + gone[sizes[2]] == 2 * least, (size, gone)


def test_capped_prefixes_are_those_of_whole_ones():
    import numpy as np

    rnd = random.Random(3)
    texts = [b"a" * 3000, b"-=" * 1500, bytes(rnd.choices(b"ab", k=2000)), b"one line of it\n" * 200, b"x" * 500 + bytes(rnd.choices(b"abc", k=300)) + b"x" * 700 + b"y" * 40 + b"x" * 300]
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        for reach in (8, 20, 100):
            order, _ = suffix_array(data, reach)
            assert (kasai(data, order, reach) == np.minimum(kasai(data, order), reach)).all()


def test_repetitive_texts_take_seconds():
    from time import perf_counter

    import numpy as np

    from tarnstone.llm.suffix_dedup import shard_repeats

    size = 4 << 20
    line = b"".join(b"%d," % (i * i) for i in range(30)) + b"\n"
    for text in (b"a" * size, b"-=" * (size // 2), line * (size // len(line)), bytes(random.Random(1).choices(b"ab", k=5000)) * (size // 5000)):
        begin = perf_counter()
        doc, pos, first, _ = shard_repeats(np.array([7]), np.array([0]), np.array([len(text) - 99]), [text], 100)
        assert len(pos) == len(text) - 99 and first.sum() == len({text[i : i + 100] for i in range(min(len(text) - 99, 6000))})
        assert perf_counter() - begin < 40


def test_a_long_repetitive_document(spark):
    rows = [(1, "=" * 3_000_000), (2, "abc" + "=" * 150), (3, "-+" * 200_000)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup_suffixes(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)).collect()}
    assert got == {1: (3_000_000 - 1, 1), 2: (150, 1), 3: (400_000 - 2, 1)}
