"""Operator 7: statistics against plain Python, the verdict against a numpy version of the estimate."""

import math
import random
import re
from collections import Counter

import numpy as np

from tarnstone.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def stats(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    seen, under = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            under |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under), len(lines)


def vector(s):
    n, chars, symbols, dup, repeat, lines = s
    share = lambda a, b: math.log1p(100 * a / max(b, 1))
    return [math.log1p(n), math.log(max(chars, 1) / max(n, 1)), share(symbols, chars), share(dup, lines), share(repeat, n)]


def quantile(x, share):
    """The histogram bin by which the share of the rows is reached."""
    b = np.sort(np.floor(np.asarray(x) * Q.BINS))
    return b[math.ceil(len(b) * share) - 1]


def estimate(x):
    x = np.array(x)
    mid = np.array([(quantile(c, 0.5) + 0.5) / Q.BINS for c in x.T])
    mad = np.array([(quantile(np.abs(c), 0.5) + 0.5) / Q.BINS for c in (x - mid).T])
    mean, cov = mid, np.diag((1.4826 * mad) ** 2 + Q.FLOORS)
    dist = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def fit(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * factor + np.diag(Q.FLOORS)

    for _ in range(Q.STEPS):
        bins = np.floor(np.log(dist() + 1e-9) * Q.BINS)
        mean, cov = fit(x[bins <= np.sort(bins)[math.ceil(len(bins) * Q.COVER) - 1]], Q.CONSISTENT_75)
    return fit(x[dist() <= Q.CHI2_975], Q.CONSISTENT_975)


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(800)]
    rows = []
    for i in range(420):
        w = rnd.choices(vocab, k=int(rnd.lognormvariate(4.8, 0.5)) + 40)
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        rows.append((i, "\n".join(lines), "en", "s0" if i % 3 else "s1"))
    for i in range(30):
        rows.append((500 + i, " ".join(x + "%%%" for x in rnd.choices(vocab, k=120)), "en", "s0"))
    rows += [(600, None, "en", "s0"), (601, "", None, None), (602, "a b c d " * 40, "en", "s0"), (603, " \t".join(vocab[:60]) + "\n\n \nx\nx\nx\n", "xx", "s9"), rows[5]]
    return rows


def test_statistics_and_verdict(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0, "c") for r in rows], "doc_id long, text string, lang string, source string, x0 double, part string")
    got = Q.judge(df, least_group=100).collect()
    assert len(got) == len(rows)
    text = {d: t for d, t, _, _ in rows}
    group = {d: (lang, source) for d, _, lang, source in rows}
    fine = {}
    for d, t, lang, source in rows:
        s = stats(t)
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0]:
            fine.setdefault((lang, source), []).append(vector(s))
    models = {g: estimate(x) for g, x in fine.items() if len(x) >= 100}
    assert ("en", "s1") in models
    for r in got:
        s = stats(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s[:5], r
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        kept = not failed
        if group[r.doc_id] in models:
            mean, cov = models[group[r.doc_id]]
            v = np.array(vector(s)) - mean
            d2 = v @ np.linalg.inv(cov) @ v
            assert abs(d2 - r.d2) < 1e-6 * max(1, d2), r
            kept = kept and d2 <= Q.CUTOFF
        assert (r.base_failed, r.kept) == (failed, kept), r
    verdict = {r.doc_id: r.kept for r in got}
    assert all(not verdict[500 + i] for i in range(30)) and all(verdict[i] for i in range(420) if stats(text[i])[0] >= 50)


def test_empty(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_languages_are_judged(spark):
    """A language of 60 documents has an estimate of its own; one of 12 and the null language take that of all."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(800)]
    text = lambda: " ".join(rnd.choices(vocab, k=int(rnd.lognormvariate(4.8, 0.3)) + 50))
    rows = [(n * 1000 + i, text(), lang) for n, (lang, size) in enumerate([("en", 150), ("fr", 60), ("xx", 12), (None, 12)]) for i in range(size)]
    rows += [(n * 1000 + 500, " ".join(x + "%%%" for x in rnd.choices(vocab, k=120)), lang) for n, lang in enumerate(["en", "fr", "xx", None])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(got) == len(rows) and all(r.d2 is not None and not r.base_failed for r in got.values())
    for n, languages in enumerate([["en"], ["fr"], ["en", "fr", "xx", None], ["en", "fr", "xx", None]]):
        x = [vector(stats(t)) for _, t, lang in rows if lang in languages]
        mean, cov = estimate(x)
        for d, t, _ in rows:
            if d // 1000 == n:
                v = np.array(vector(stats(t))) - mean
                d2 = v @ np.linalg.inv(cov) @ v
                assert abs(d2 - got[d].d2) < 1e-6 * max(1, d2) and got[d].kept == (d2 <= Q.CUTOFF), got[d]
    assert {d for d, r in got.items() if not r.kept} == {500, 1500, 2500, 3500}
