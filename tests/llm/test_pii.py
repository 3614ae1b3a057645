"""Operator 2: base spans against Python's regular expressions, revealing terms on a planted corpus."""

import hashlib
import random
import re

from tarnstone.llm.pii import sanitise, scan

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PATTERNS.items()}


def corpus():
    rnd = random.Random(6)
    bits = ["a.b@c.de", "@", "x@y", "q_r@z.com_w@v.org", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "+1 (319) 555-5132", "+12", "+1 555 5132 ", "4041894974608795", "4041-8949 7460 8795", "4539 1488 0343 6467", "é", "漢字", "word", " ", "\n", ".", "+", "-", "99", "😀"]
    rows = [(i, rnd.choice(["", " "]).join(rnd.choices(bits, k=rnd.randint(0, 25)))) for i in range(150)]
    return [*rows, (500, None), (501, ""), (502, "a" * 60000), (503, "1" * 60000), (504, "1." * 30000), (505, "+" + "(" * 60000), (506, "a@" + "b." * 20000), rows[3]]


def test_base(spark):
    rows = corpus()
    got = scan(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, kind int, spans string"), support=10**6).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(dict(rows)[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], (r, want)
        assert r.spans == text and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_revealing_terms(spark):
    rnd = random.Random(1)
    vocab = [f"{a}{b}" for a in ["alpha", "beta", "gamma", "delta", "sigma"] for b in ["one", "two", "ter", "quat"]]
    rows = [(i, " ".join(rnd.choices(vocab, k=40))) for i in range(60)]
    for i in range(6):
        t = rnd.choices(vocab, k=20)
        t[10:10] = ["Snowdrop", "ed@whistle.org", "called"]
        rows.append((100 + i, " ".join(t)))
    for i in range(5):  # copies of one passage prove nothing
        rows.append((200 + i, "solitary passage bob@host.org with lonely words " + "and more of them " * 8 + "x" * i))
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, __id long")
    got = {r.doc_id: r for r in scan(df).collect()}
    for i in range(6):
        text = rows[60 + i][1]
        at = text.index("Snowdrop")
        assert f"term:{at}:{at + 8}" in got[100 + i].spans.split(","), got[100 + i]
        assert got[100 + i].n_term == 2 and got[100 + i].n_email == 1
    assert all(got[i].spans == "" for i in range(60)) and all(got[200 + i].n_term == 0 for i in range(5))
    clean = {r.doc_id: r for r in sanitise(df).collect()}
    assert "Snowdrop" not in clean[100].text and "[email]" in clean[100].text and clean[0].text == rows[0][1] and clean[0]["__id"] == 7


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def base_corpus():
    rnd = random.Random(3)
    vocab = [a + b for a in "bcdfg" for b in ["one", "two", "ter", "quat"]]
    return rnd, vocab, [(i, " ".join(rnd.choices(vocab, k=40))) for i in range(60)]


def test_terms_of_the_whole_text(spark):
    """A short name and a code far from the entity are found, and each of their occurrences is marked."""
    rnd, vocab, rows = base_corpus()
    for i in range(6):
        words = lambda: " ".join(rnd.choices(vocab, k=60))
        rows.append((100 + i, f"Kim {words()} ed@whistle.org {words()} X7Q {words()} kim, {words()} (X7Q)"))
    rows.append((200, "kim " + rows[0][1]))  # without the entity, nothing is marked
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), disclosure=0.8).collect()}
    for d, text in rows[60:66]:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\b(?:Kim|kim|X7Q)\b", text)]
        assert len(want) == 4 and [s for s in got[d].spans.split(",") if s.startswith("term")] == want, got[d]
    assert got[200].spans == "" and all(got[i].spans == "" for i in range(60))


def test_copies_hide_no_term(spark):
    """A passage with an entity and its term, copied exactly and nearly, counts once in every count."""
    rnd, vocab, rows = base_corpus()
    one = " ".join(rnd.choices(vocab, k=60)) + " Snowdrop ed@whistle.org " + " ".join(rnd.choices(vocab, k=60))
    rows += [(100 + i, one) for i in range(100)] + [(300 + i, f"{one} {vocab[i % 20]}") for i in range(100)]
    for i in range(2):
        rows.append((500 + i, " ".join(rnd.choices(vocab, k=20)) + " Snowdrop ed@whistle.org " + " ".join(rnd.choices(vocab, k=20))))
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_term == (r.doc_id >= 100) for r in got), [r for r in got if r.n_term != (r.doc_id >= 100)][:3]


def test_keys_are_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'a token = "{key}" here'), (2, "a" * 60 + " " + "7" * 60 + " " + "_" * 40), (3, key[:31]), (4, f"{key}.{key}"), (5, f"me@{key}.org {'-' * 50}")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.n_secret for d, r in got.items()} == {1: 1, 2: 0, 3: 0, 4: 2, 5: 1} and got[1].spans == "secret:11:51" and got[5].n_email == 1
    assert sanitise(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().text == 'a token = "[secret]" here'
