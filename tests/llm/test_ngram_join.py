"""Operator 4 against brute force over all pairs."""

import random
import re

from tarnstone.llm.ngram_join import near_duplicates

SCHEMA = "doc_id long, text string, n long, tokens string"


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["The", "the", "É", "é"]
    rows, texts = [], []
    for _ in range(60):
        base = rnd.choices(vocab, k=rnd.choice([3, 5, 6, 30, 60, 120]))
        texts.append(base)
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            new = list(rnd.choice(texts[-8:]))
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                new[rnd.randrange(len(new))] = rnd.choice(vocab)
            texts.append(new)
    rnd.shuffle(texts)
    rows = [(i, rnd.choice([" ", "\n"]).join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "A  B"), (905, "x " * 50), (None, rows[0][1]), rows[1]]
    return rows


def test_components(spark):
    rows = corpus()
    want = brute(rows)
    got = near_duplicates(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    assert len({c for _, c in want.values()}) < len(want) - 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_and_other_settings(spark):
    rows = [r for r in corpus() if r[0] is not None]
    want = {d: c for d, (_, c) in brute(rows).items()}
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    for levels in (7,):
        assert {r.doc_id: r.component_id for r in near_duplicates(df, levels=levels).collect()} == want
    strict = {r.doc_id: r.component_id for r in near_duplicates(df, similarity=100).collect()}
    sets = {d: frozenset(shingles(t)) for d, t in rows}
    assert strict == {d: min(e for e in sets if e == d or sets[e] and sets[e] == sets[d]) for d in sets}


def test_texts_that_share_an_id(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    a, b, c = (" ".join(rnd.choices(words, k=100)) for _ in range(3))
    rows = [(5, a), (5, b), (5, a), (7, a + " more"), (9, b + " more"), (8, c), (None, a), (None, c), (3, c + " more")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()), key=repr)
    n = lambda t: len(shingles(t))
    assert got == sorted([(5, n(a), 5), (5, n(b), 5), (5, n(a), 5), (7, n(a) + 1, 5), (9, n(b) + 1, 5), (8, n(c), 3), (3, n(c) + 1, 3), (None, n(a), None), (None, n(c), None)], key=repr)
