"""Operators 5 and 9 against the libraries, on the table and on odd texts."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnstone.llm.bpe_codec import WordCodec, encode_decode
from tarnstone.llm.token_counts import PieceCounter, count_tokens

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COUNTER, CODEC = PieceCounter(public_tokenizers.path("piece_bpe_32k.model")), WordCodec(public_tokenizers.path("word_bpe_49k.json"))
PARTS = [*"abcdeth the  \n\t▁.,!'s're12éßΣİĲ中文ﬁ①́😀|>", "<s>", "</s>", "<|startoftext|>", "<|endoftext|>", "   ", "<0x0A>", "\x1c", "\x85", "　"]


def check(text):
    assert COUNTER(text) == len(PIECES.encode(text)), repr(text)
    want = WORDS.encode(text, add_special_tokens=False).ids
    ids, names, n = next(CODEC.encode_batch([text]))
    assert (ids, names, n) == (" ".join(map(str, want)), WORDS.decode(want, skip_special_tokens=False), len(want)), repr(text)
    assert CODEC.decode(want) == names


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_mixed(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=40))
def test_any_text(text):
    assert COUNTER(text) == len(PIECES.encode(text)), repr(text)


def test_long_words():
    rnd = random.Random(1)
    for text in ["a" * 5000, "ab" * 3000, "▁" * 300, " " * 300, "".join(rnd.choices("thein", k=4000)), "\n" * 500, "the" * 2000 + " the"]:
        check(text)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in count_tokens(docs).collect():
        n = len(PIECES.encode(rows[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 4096)
    for r in encode_decode(docs, digests=True).collect():
        want = WORDS.encode(rows[r.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(" ".join(map(str, want))), sha(WORDS.decode(want, skip_special_tokens=False)))


def test_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a", 6)], "doc_id long, text string, n_tokens long")
    assert [(r.n_bytes, r.n_tokens) for r in count_tokens(df).orderBy("n_bytes").collect()] == [(0, 0), (0, 0), (1, 1)]
    assert [r.token_ids for r in encode_decode(df).orderBy("n_tokens").collect()][:2] == ["", ""]
    assert count_tokens(df.limit(0)).count() == 0 and encode_decode(df.limit(0)).count() == 0


def test_the_text_is_decoded_from_the_identifiers():
    codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    ids, names, _ = next(codec.encode_batch(["the end"]))
    codec.names[ids.split()[0]] = "changed"
    assert next(codec.encode_batch(["the end"]))[1] == " ".join(["changed", *names.split(" ")[1:]])


def test_every_code_point():
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}-{chr(c)}a" for c in points[i : i + 50_000]]
        want = WORDS.encode_batch(texts, add_special_tokens=False)
        got = CODEC.encode_batch(texts)
        assert [t for t, w, (ids, _, _) in zip(texts, want, got, strict=True) if " ".join(map(str, w.ids)) != ids] == []


def test_marks_in_any_order():
    rnd = random.Random(4)
    marks = [chr(c) for c in [0x301, 0x323, 0x327, 0x334, 0x345, 0x94D, 0xC3C, 0x7FD, 0x898, 0x1ABF, 0x1715, 0x1E08F, 0x11930, 0x11935, 0x11938, 0x1193D, 0x20D0]]
    for _ in range(3000):
        check("".join(rnd.choices(["a", "e", "ẛ", "ά", "한", "ᄒ", "ᅡ", " ", *marks], k=rnd.randint(1, 8))))
