"""Segmentation against enumeration of all cuts and of all state paths."""

import itertools
import math
import random

import pytest

from tarnstone.functions import segment as G
from tarnstone.plans.q_segment import WORDS, model

CHARS = "今天气很好我们实体组件渲染控制器"


def cuts(text):
    for marks in itertools.product((False, True), repeat=len(text) - 1):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(text)]
        yield [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def texts(n, longest):
    rnd = random.Random(n)
    words = [w.split()[0] for w in WORDS]
    for _ in range(n):
        yield "".join(rnd.choice(words) if rnd.random() < 0.5 else rnd.choice(CHARS) for _ in range(rnd.randint(1, 6)))[:longest]


@pytest.fixture
def segmenter():
    return G.Segmenter(G.Lexicon.parse(WORDS), model())


@pytest.mark.parametrize("longest", [2, 512])
def test_dictionary_path_is_the_heaviest_cut(segmenter, longest):
    weight, lowest = segmenter.lexicon.weight, segmenter.lexicon.lowest

    def total(words):
        return sum(weight[w] if w in weight else lowest if len(w) == 1 else -math.inf for w in words)

    for text in texts(150, 10):
        best = max(total(c) for c in cuts(text) if all(len(w) <= longest for w in c))
        got = segmenter.mp(text, longest)
        assert "".join(got) == text and all(len(w) <= longest for w in got) and math.isclose(total(got), best)


def test_model_path_is_the_likeliest(segmenter):
    m = segmenter.markov

    def score(text, states):
        s = m.start[states[0]] + m.emit[states[0]].get(text[0], G.LOWEST)
        for i in range(1, len(text)):
            s += m.trans[states[i - 1]][states[i]] + m.emit[states[i]].get(text[i], G.LOWEST)
        return s

    for text in texts(60, 6):
        paths = [p for p in itertools.product(range(4), repeat=len(text)) if p[-1] in (1, 3)]
        most = max(score(text, p) for p in paths)
        possible = set()
        for p in paths:
            if math.isclose(score(text, p), most, rel_tol=1e-12):
                ends = [i + 1 for i, s in enumerate(p) if s in (1, 3)]
                possible.add(tuple(text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)))
        assert tuple(segmenter.hmm(text)) in possible, text


def test_full_and_search(segmenter):
    known = segmenter.lexicon.weight
    for text in texts(100, 12):
        spans = [(i, j) for i in range(len(text)) for j in range(i + 2, len(text) + 1) if text[i:j] in known]
        covered = {k for i, j in spans for k in range(i, j)}
        want = sorted([*spans, *[(k, k + 1) for k in range(len(text)) if k not in covered]])
        assert segmenter.full(text) == [text[i:j] for i, j in want]
        mixed = segmenter.mix(text)
        want = [x for w in mixed for x in [w[i : i + n] for n in (2, 3) if len(w) > n for i in range(len(w) - n + 1) if w[i : i + n] in known] + [w]]
        assert "".join(mixed) == text and segmenter.search(text) == want
        rest = iter(mixed)
        assert all(w in rest for w in segmenter.mp(text) if len(w) > 1), "the dictionary's words stay, in order"


def test_words_in_one_pass():
    rnd = random.Random(5)
    for _ in range(200):
        words = {"".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(rnd.randint(0, 12))}
        text = "".join(rnd.choices("abcd", k=30))
        want = [[n for n in range(1, len(text) - i + 1) if text[i : i + n] in words] for i in range(len(text))]
        assert G.Words(words).starting(text) == want


def test_a_long_word_costs_no_time():
    from time import perf_counter

    long = "".join(random.Random(1).choices(CHARS, k=512))
    text = (long[:511] + "龙") * 200

    def taken(words):
        s = G.Segmenter(G.Lexicon.parse(words))
        s.mp("今")
        begin = perf_counter()
        out = s.mp(text)
        return perf_counter() - begin, out

    with_long, out = taken([*WORDS, f"{long} 5 n"])
    without, same = taken(WORDS)
    assert out == same and with_long < 4 * without + 0.2


def test_inserted_and_deleted_words_count_at_once(segmenter):
    assert segmenter.mp("龙与地下城") == list("龙与地下城")
    segmenter.lexicon.insert("地下城")
    assert segmenter.mp("龙与地下城") == ["龙", "与", "地下城"]
    segmenter.lexicon.delete("地下城")
    assert segmenter.mp("龙与地下城") == list("龙与地下城")


def test_text_without_dictionary_words_is_cut_at_once(segmenter):
    from time import perf_counter

    text = "今天天气很好 " + "It rained, on the 3rd of May; nobody (but déjà-vu) minded.\n" * 12_000
    begin = perf_counter()
    mixed, path, tags = segmenter.mix(text), segmenter.mp(text), segmenter.tags(text)
    assert perf_counter() - begin < 4  # 8.2 s before
    assert "".join(mixed) == "".join(path) == "".join(w for w, _ in tags) == text and mixed[:5] == ["今天", "天气", "很好", " ", "It"]


@pytest.mark.parametrize("own", [(), ("很", "Z")])
def test_parts_are_cut_as_the_whole(own):
    """The parts that no dictionary word can begin in, beside the path over every character and the model over what is loose."""
    s = G.Segmenter(G.Lexicon.parse([*WORDS, "T恤 5 n", "，今 9 n", "天 4 n"], own), model())
    rnd = random.Random(7)
    for _ in range(1500):
        text = "".join(rnd.choices(CHARS + "，。 \t\n\rab12.Zé龙-T恤😀", k=rnd.randint(0, 40)))
        path = [w for run in s.runs(text) for w in s._longest_path(run, 512)]
        assert s.mp(text) == path and s.mix(text) == s._mixed(path)
        assert s.hmm(text) == [w for run in s.runs(text) for w in s.markov.cut(run)]
        assert s.tokens(text) == [w for w in s.search(text) if w not in (" ", "\t", "\n")]


def test_rows_become_python_objects_in_bounded_parts():
    import pyarrow as pa

    texts = ["x" * (i % 50 * 40) if i % 7 else None for i in range(3000)] + ["y" * 50_000] + [""] * 5
    parts = [p.to_pylist() for p in G.slices(pa.array(texts), most=10_000)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 10_000 for p in parts) and len(parts) < 600


def test_texts_ranked_together_are_ranked_as_alone():
    import pyarrow as pa
    import pyarrow.compute as pc

    rnd = random.Random(3)
    docs = [[], ["a"], ["a"] * 9, ["b", "a"], sorted(f"w{i:04}" for i in range(300)), *[[f"w{min(int(rnd.expovariate(0.1)), 90)}" for _ in range(rnd.randint(0, 120))] for _ in range(300)]]
    got = [[] for _ in docs]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.string()))], ["doc_id", "words"])
    for part in G.slices(rows, "words", 20_000):
        at, words, weights = G.textranks(pc.list_parent_indices(part["words"]).to_numpy(), part["words"].flatten())
        for i, w, x in zip(at.tolist(), words.to_pylist(), weights.tolist(), strict=True):
            got[part["doc_id"][i].as_py()].append((w, x))
    for words, have in zip(docs, got, strict=True):
        want = sorted(G.textrank(words).items(), key=lambda x: (-x[1], x[0]))
        assert [w for w, _ in have] == [w for w, _ in want] and all(math.isclose(x, y, rel_tol=1e-12) for (_, x), (_, y) in zip(have, want, strict=True))
