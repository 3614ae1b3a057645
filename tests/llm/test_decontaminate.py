"""Operator 6 against brute force over all alignments."""

import random
import re

from tarnstone.llm.decontaminate import contaminated, remove_contaminated, seeds


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, window=13, wrong=2, least=5):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            k = min(window, len(v))
            if len(v) < least:
                continue
            most = wrong if len(v) >= window else 0
            for a in range(len(v) - k + 1):
                for p in range(len(w) - k + 1):
                    if sum(y != z for y, z in zip(v[a : a + k], w[p : p + k])) <= most:
                        hit = out.setdefault((d, i), (set(), set(), []))
                        hit[0].add(a)
                        hit[1].update(range(a, a + k))
                        hit[2].append(p)
    return {key: (len(a), len(c), min(p)) for key, (a, c, p) in out.items()}


def test_seeds_are_lossless():
    from itertools import combinations

    for gone in combinations(range(13), 2):
        assert any(not set(gone) & set(m) for m in seeds())


def test_leaks(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(200)] + ["The", "é"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 5, 9, 13, 14, 30, 50])))) for i in range(25)] + [(90, None), (91, ""), (92, "x " * 20)]
    docs = []
    for d in range(60):
        w = rnd.choices(vocab, k=rnd.randint(0, 60))
        if rnd.random() < 0.7:
            v = words(rnd.choice(items)[1])
            a = rnd.randrange(max(1, len(v) - 8))
            v = [x if rnd.random() > 0.08 else rnd.choice(vocab) for x in v[a:]]
            at = rnd.randint(0, len(w))
            w[at:at] = v
        docs.append((d, rnd.choice([" ", "\n"]).join(w).upper() if d % 9 == 0 else " ".join(w)))
    docs += [(70, None), (71, ""), (72, "X x " * 20), docs[2]]
    want = brute(docs, items)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id long, mask int")
    got = contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.first_word) for r in got} == want and len(got) == len(want) > 15
    left = remove_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contaminated(docs, some).count() == 0 and contaminated(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0


def test_long_item(spark):
    import time

    rnd = random.Random(6)
    item = [f"w{rnd.randrange(10**6)}" for _ in range(20_000)]
    docs = [(1, " ".join(item[19_000:19_020])), (2, "nothing of the kind " * 9), (3, " ".join(item[:12]))]
    began = time.time()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, r.n_windows, r.n_matched, r.first_word) for r in got] == [(1, 20_000, 8, 20, 0)]
    assert time.time() - began < 60


def test_texts_that_share_an_id(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(None, leak), (None, "clean"), (4, leak), (4, "clean too"), (4, None)]
    left = remove_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert sorted(left.collect(), key=repr) == sorted([(None, "clean"), (4, "clean too"), (4, None)], key=repr)
