"""Operator 9, BPE encoding and decoding: a trie of distinct words, traversed depth first with last-token states."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm.common import read_table

MODEL = "word_bpe_49k.json"
#: Characters of words (with a share for each entry) that a worker remembers in each of two generations, and token pairs, which
#: are forgotten together when so many are known; results do not depend on either.
CACHE_CHARS = 18_000_000
CACHE_PAIRS = 400_000

#: Ranges of marks that Unicode gained after version 9, whose tables the library's normaliser has. To it, they are
#: no marks: nothing is ordered past them. The pair 0x11930, 0x11938 is one composition of that kind.
YOUNG = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: Capitals that unicodedata does not know as such yet, and their small letters.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Ranges that hold the letters and digits of Unicode 16, which the library's pattern knows and unicodedata does
#: not; what the pattern library counts as letter or digit beyond these and unicodedata is none to the library.
SIXTEEN = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D4F), (0x10D50, 0x10D65), (0x10D6F, 0x10EC4),
    (0x11380, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]
#: A code point that is no letter, digit or blank in any version.
NONE = "\uffff"


def ranges(codes: list[int]) -> str:
    """The inside of a character class of ascending code points."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class WordCodec:
    """Encodes and decodes as the vocabulary file says.

    A word's tokens are fixed by one state for each of its prefixes, the last token of the prefix's own encoding: a token
    t that ends the prefix is that state if the rest before it is empty or if t may follow the rest's last token, that is
    if the merges keep the two apart. Words are put into a trie, and a depth-first walk hands each node's state down, so
    that a prefix shared by many words is worked out once.
    """

    def __init__(self, model_path: str):
        import regex

        with open(model_path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {p: i for i, p in enumerate(pairs)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.numbers = {t: str(i) for t, i in self.vocab.items()}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names |= {str(i): t for i, t in self.names.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        # The same pattern where a text has no other letters, digits and blanks than these.
        plain = split.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r\x20")
        self.find_ascii = re.compile(plain).findall if r"\p" not in plain else self.find
        # Letters and digits that the pattern library knows and unicodedata does not, and those that the library does not know.
        known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000))
        fresh = [ord(c) for c in known if unicodedata.category(c) == "Cn"]
        self.fresh = re.compile(f"[{ranges(fresh)}]")
        # What a pattern of few ranges tells at once: texts without any of these need no normaliser and hold nothing fresh or young.
        self.rare = re.compile("[\u0300-\u2001\u2070-\u209f\u20d0-\U0010ffff]")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.fresh_below = re.compile(f"[{ranges([c for c in fresh if c < 0x10000])}]")
        self.newer = re.compile(f"[{ranges([c for c in fresh if not any(a <= c <= b for a, b in SIXTEEN)])}]")
        self.young = re.compile(f"([{''.join(f'{chr(a)}-{chr(b)}' for a, b in YOUNG)}])")
        self.finditer = regex.compile(split.replace(r"\s", r"\p{White_Space}")).finditer
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_alphabet()
        self.longest = max(len(t) for t in self.vocab)
        self.made: dict[str, tuple[int, tuple[str, str]]] = {}
        for p, i in self.merges.items():
            self.made.setdefault(p[0] + p[1], (i, p))
        self.right_spine: dict[str, list[tuple[str, int]]] = {}
        self.left_spine: dict[str, list[tuple[str, int]]] = {}
        self.words: dict[str, tuple[str, ...]] = {}
        self.old: dict[str, tuple[str, ...]] = {}
        self.size = 0
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, word: str) -> list[str]:
        out = [self.bytes[b] for b in word.encode()]
        out[-1] += self.end
        return out

    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The symbols that stand at one edge of a token while it is being merged, each with the rank that ends it."""
        out, ends = [], 1 << 60
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out
            ends, parts = self.made[token]
            token = parts[1 if right else 0]

    def may_follow(self, left: str, right: str) -> bool:
        """True if no merge joins the two: none whose symbols stand at the touching edges before it is its turn.

        Among equal ranks the leftmost pair goes first, so a merge across the border beats an equal one to its right.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            if left not in self.right_spine:
                self.right_spine[left] = self.spine(left, True)
            if right not in self.left_spine:
                self.left_spine[right] = self.spine(right, False)
            rank, known = self.merges.get, True
            for x, x_ends in self.right_spine[left]:
                for y, y_ends in self.left_spine[right]:
                    r = rank((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def learn(self, words: set[str]) -> None:
        """Works out the tokens of new words through a trie."""
        trie: dict = {}
        for word in words:
            node = trie
            for s in self.symbols(word):
                node = node.setdefault(s, {})
            node[""] = word
        vocab, end = self.vocab, self.end
        # A path entry is (symbol, last token of the prefix that ends here, where that token starts).
        path: list[tuple[str, str, int]] = []
        stack = [(0, s, child) for s, child in trie.items()]
        while stack:
            depth, symbol, node = stack.pop()
            del path[depth:]
            token, start = symbol, depth
            while True:
                if token in vocab and (not start or self.may_follow(path[start - 1][1], token)):
                    break
                start -= 1
                if start < 0 or len(token) > self.longest + len(end):
                    raise ValueError(f"no encoding for a prefix that ends with {symbol!r}")
                token = path[start][0] + token
            path.append((symbol, token, start))
            for s, child in node.items():
                if s == "":
                    tokens, at = [], depth + 1
                    while at > 0:
                        tokens.append(path[at - 1][1])
                        at = path[at - 1][2]
                    self.keep(child, tokens[::-1])
                else:
                    stack.append((depth + 1, s, child))

    def keep(self, word: str, tokens: list[str]) -> None:
        self.size += len(word) + 8 * len(tokens) + 80
        self.words[word] = tuple(map(self.numbers.__getitem__, tokens))

    def split(self, text: str) -> list[str]:
        """Words to encode. Blanks fall away here, so those that the normaliser makes equal need not be."""
        if text.isascii():
            return self.find_ascii(text.lower())
        if self.rare.search(text) is None:
            return self.find(text.lower())
        if not unicodedata.is_normalized("NFC", text) or self.young.search(text):
            text = "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(self.young.split(text)))
        text = text.replace("Σ", "σ").lower()
        if self.fresh_below.search(text) or self.beyond.search(text) and self.fresh.search(text):
            text = text.translate(CAPITALS)
            return [text[m.start() : m.end()] for m in self.finditer(self.newer.sub(NONE, text))]
        return self.find(text)

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special strings: (is special, piece)."""
        if self.find_special is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(i % 2 == 1, x) for i, x in enumerate(self.find_special.split(text))]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """For each text: identifiers joined by a space, the text decoded from them, number of tokens."""
        for text in texts:
            ids: list[str] = []
            for special, piece in self.parts(text):
                if special:
                    ids.append(str(self.special[piece]))
                    continue
                found = self.split(piece)
                new = set(found).difference(self.words)
                if new:
                    if self.size > CACHE_CHARS:
                        # Words not met since the last time go; those met again are taken over.
                        self.old, self.words, self.size, new = self.words, {}, 0, set(found)
                    again = {word for word in new if word in self.old}
                    for word in again:
                        self.words[word] = tokens = self.old[word]
                        self.size += len(word) + 8 * len(tokens) + 80
                    self.learn(new - again)
                ids.extend(chain.from_iterable(map(self.words.__getitem__, found)))
            yield " ".join(ids), self.decode(ids), len(ids)

    def decode(self, ids: list[int] | list[str]) -> str:
        """The vocabulary file names no decoder: tokens are joined by one space. Identifiers are numbers or decimal."""
        return " ".join(map(self.names.__getitem__, ids))


@cache
def codec_of(model_path: str) -> WordCodec:
    """One codec a worker process, so that its tasks share what it has learnt."""
    return WordCodec(model_path)


def encode_decode(docs: DataFrame, text_col: str = "text", model_path: str | None = None, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, token_ids (decimal, joined by a space) and decoded text; digests: SHA-256 of both instead.

    A null or empty text has no tokens and decodes to an empty text; special strings inside a text become their
    identifiers, as the library does by default; repeated rows and rows without an id are each encoded; very long texts are
    encoded whole; an empty table gives an empty one; other columns are not looked at.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    second = ("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded")

    @F.pandas_udf(f"n_tokens long, {second[0]} string, {second[1]} string")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for s in texts:
            rows = [(n, sha(i), sha(d)) if digests else (n, i, d) for i, d, n in codec.encode_batch(s)]
            yield pd.DataFrame(rows, columns=["n_tokens", *second])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), encoded(text).alias("e")).select("doc_id", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), digests=True)
