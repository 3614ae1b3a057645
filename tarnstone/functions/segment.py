"""Chinese segmentation: dictionary paths, a four-state hidden Markov model, and their mixtures; pure Python for Arrow UDFs.

The dictionary and the model are files of the user's: a dictionary has a word, a frequency and a tag a line; a model has
start, transition and emission log probabilities of the states B, E, M, S. Nothing is shipped here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 512
LOWEST = -3.14e100
#: Cut points between runs.
BREAKS = re.compile("[ \t\n，。]")
_ASCII = re.compile("[A-Za-z][A-Za-z0-9]*|[0-9.]+")
#: Separators, letter and number runs, and the runs between them whose path the model looks for; what the first three begin with.
_RUNS = re.compile("[ \t\n，。]|[A-Za-z][A-Za-z0-9]*|[0-9.]+|[^ \t\n，。A-Za-z0-9.]+")
_PLAIN = frozenset(" \t\n，。.0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ANY_ASCII = re.compile("[\x00-\x7F]")
_BLANK = frozenset(("", " ", "\t", "\n"))


def _lines(spark, path: str) -> list[str]:
    """The lines of one file, in order."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).splitlines()


def load_weights(spark, path: str) -> dict[str, float]:
    """word to weight, from a file of a word and a number a line; other lines are passed over."""
    rows = [x.split() for x in _lines(spark, path)]
    return {r[0]: float(r[1]) for r in rows if len(r) == 2 and r[1].replace(".", "", 1).isdigit()}


class Words:
    """All words of a dictionary inside a text in one pass over it, by a prefix trie with links between its nodes.

    A node stands for a prefix of a word. Its link leads to the longest proper suffix of that prefix that is a prefix of a
    word, too; its exit leads to the longest that is a word. Time goes with the text and the words found, however long the
    dictionary's longest word is.
    """

    CODES = 0x110000

    def __init__(self, words: Iterable[str]):
        self.next: dict[int, int] = {}
        self.size, parent, letter = [0], [0], [0]
        for word in words:
            at = 0
            for c in word:
                key = at * self.CODES + ord(c)
                to = self.next.get(key)
                if to is None:
                    to = self.next[key] = len(self.size)
                    self.size.append(0)
                    parent.append(at)
                    letter.append(ord(c))
                at = to
            self.size[at] = len(word)
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # a node comes after its parent
            depth[node] = depth[parent[node]] + 1
        self.link, self.exit = [0] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            at = parent[node]
            while at:
                at = self.link[at]
                to = self.next.get(at * self.CODES + letter[node])
                if to is not None:
                    self.link[node] = to
                    break
            link = self.link[node]
            self.exit[node] = link if self.size[link] else self.exit[link]

    def starting(self, text: str) -> list[list[int]]:
        """For each place of the text the lengths of the words that start there, ascending."""
        found: list[list[int]] = [[] for _ in text]
        step, at = self.next.get, 0
        for i, c in enumerate(text):
            code = ord(c)
            to = step(at * self.CODES + code)
            while to is None and at:
                at = self.link[at]
                to = step(at * self.CODES + code)
            at = to or 0
            node = at if self.size[at] else self.exit[at]
            while node:
                found[i + 1 - self.size[node]].append(self.size[node])
                node = self.exit[node]
        return found


@dataclass
class Lexicon:
    weight: dict[str, float] = field(default_factory=dict)
    tag: dict[str, str] = field(default_factory=dict)
    user: set[str] = field(default_factory=set)
    lowest: float = 0.0
    median: float = 0.0
    _words: Words | None = field(default=None, repr=False, compare=False)
    _firsts: re.Pattern | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        """Without the trie and the pattern, which each process builds when it first cuts a text."""
        return self.__dict__ | {"_words": None, "_firsts": None}

    def starting(self, text: str) -> list[list[int]]:
        """For each place the lengths of the dictionary's words that start there, ascending."""
        if self._words is None:
            self._words = Words(self.weight)
        return self._words.starting(text)

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether a word of two characters or more may begin in it, part): the parts of a text, cut beside separators.

        The first are single runs; the others are of any length, and in them each character is a word of its own.
        """
        if self._firsts is None:
            found = "".join(re.escape(c) for c in sorted({w[0] for w in self.weight if len(w) > 1}) if not BREAKS.match(c))
            self._firsts = re.compile(f"[{found}]" if found else "(?!)")
        at, first = 0, self._firsts.search(text)
        while first:
            begin = max(text.rfind(c, at, first.start()) + 1 or at for c in " \t\n，。")
            stop = BREAKS.search(text, first.start())
            end = stop.start() if stop else len(text)
            if begin > at:
                yield False, text[at:begin]
            yield True, text[begin:end]
            at, first = end, self._firsts.search(text, end)
        if at < len(text):
            yield False, text[at:]

    @staticmethod
    def parse(lines: Iterable[str], user: Iterable[str] = ()) -> Lexicon:
        rows = [x.split(" ") for x in (line.strip() for line in lines) if x]
        rows = [r for r in rows if len(r) == 3]
        total = sum(float(r[1]) for r in rows) or 1.0
        out = Lexicon({w: math.log(float(f) / total) for w, f, _ in rows}, {w: t for w, _, t in rows})
        ranked = sorted(out.weight.values())
        out.lowest = ranked[0] if ranked else 0.0
        out.median = ranked[len(ranked) // 2] if ranked else 0.0
        for line in user:
            parts = line.strip().split(" ")
            if parts[0]:
                out.insert(parts[0], float(parts[1]) if len(parts) == 3 and parts[1].isdigit() else None, parts[-1] if len(parts) > 1 else "", total)
        return out

    @staticmethod
    def load(spark, path: str, user_path: str | None = None) -> Lexicon:
        """From dictionary files on any store Spark reads; each is one dictionary, so it is small enough for the driver."""
        return Lexicon.parse(_lines(spark, path), _lines(spark, user_path) if user_path else ())

    def insert(self, word: str, freq: float | None = None, tag: str = "", total: float = 1.0) -> None:
        self.weight[word] = math.log(freq / total) if freq else self.median
        self.tag[word] = tag
        self.user.add(word)
        self._words = self._firsts = None

    def delete(self, word: str) -> bool:
        self._words = self._firsts = None
        return self.weight.pop(word, None) is not None

    def find(self, word: str) -> bool:
        return word in self.weight


@dataclass
class Markov:
    """start and trans over the states BEMS; emit: a dictionary of characters for each."""

    start: list[float]
    trans: list[list[float]]
    emit: list[dict[str, float]]
    #: The paths of short runs, such as punctuation; at most 65,536.
    _short: dict[str, list[str]] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def parse(lines: Iterable[str]) -> Markov:
        rows = [x for x in (line.strip() for line in lines) if x and not x.startswith("#")]
        numbers = [[float(v) for v in r.split()] for r in rows[:5]]
        emit = [{pair.rsplit(":", 1)[0]: float(pair.rsplit(":", 1)[1]) for pair in r.split(",") if ":" in pair} for r in rows[5:9]]
        return Markov(numbers[0], numbers[1:5], emit)

    @staticmethod
    def load(spark, path: str) -> Markov:
        return Markov.parse(_lines(spark, path))

    def cut(self, text: str) -> list[str]:
        """Letter and number runs stay whole; the rest is cut behind the states E and S of the likeliest path."""
        out, at = [], 0
        for m in _ASCII.finditer(text):
            out += self._path(text[at : m.start()]) + [m.group()]
            at = m.end()
        return out + self._path(text[at:])

    def pieces(self, text: str) -> list[str]:
        """The cut of each run between separators, and each separator, in order."""
        runs, out, at = _RUNS.findall(text), [], 0
        for i in [i for i, run in enumerate(runs) if run[0] not in _PLAIN]:
            out += runs[at:i]
            out += self._path(runs[i])
            at = i + 1
        return out + runs[at:]

    def _path(self, text: str) -> list[str]:
        if len(text) > 8:
            return self._likeliest(text)
        found = self._short.get(text)
        if found is None:
            if len(self._short) >= 65536:
                self._short.clear()
            found = self._short[text] = self._likeliest(text)
        return found

    def _likeliest(self, text: str) -> list[str]:
        if not text:
            return []
        emit = [e.get for e in self.emit]
        into = list(zip(range(4), zip(*self.trans, strict=True), emit, strict=True))
        score = [self.start[s] + emit[s](text[0], LOWEST) for s in range(4)]
        back = []
        for c in text[1:]:
            best, now = [0, 0, 0, 0], [0.0, 0.0, 0.0, 0.0]
            s0, s1, s2, s3 = score
            for s, (t0, t1, t2, t3), of in into:
                p, most = 0, s0 + t0
                if s1 + t1 > most:
                    p, most = 1, s1 + t1
                if s2 + t2 > most:
                    p, most = 2, s2 + t2
                if s3 + t3 > most:
                    p, most = 3, s3 + t3
                best[s], now[s] = p, most + of(c, LOWEST)
            score = now
            back.append(best)
        state = 1 if score[1] >= score[3] else 3
        states = [state]
        for best in reversed(back):
            state = best[state]
            states.append(state)
        out, begin = [], 0
        for i, s in enumerate(reversed(states)):
            if s in (1, 3):
                out.append(text[begin : i + 1])
                begin = i + 1
        return out + ([text[begin:]] if begin < len(text) else [])


class Segmenter:
    def __init__(self, lexicon: Lexicon, markov: Markov | None = None):
        self.lexicon, self.markov = lexicon, markov

    def described(self) -> tuple:
        """What its tokens depend on, for a fingerprint."""
        m = self.markov
        return sorted(self.lexicon.weight.items()), sorted(self.lexicon.user), m and (m.start, m.trans, [sorted(e.items()) for e in m.emit])

    @staticmethod
    def runs(text: str) -> list[str]:
        """Runs between separators, each separator a run of its own."""
        return [x for x in re.split(f"({BREAKS.pattern})", text) if x]

    def _longest_path(self, text: str, longest: int) -> list[str]:
        weight, n = self.lexicon.weight, len(text)
        best, step, starting = [0.0] * (n + 1), [1] * n, self.lexicon.starting(text)
        for i in range(n - 1, -1, -1):
            most = weight.get(text[i], self.lexicon.lowest) + best[i + 1]
            for size in starting[i]:
                if 1 < size <= longest and (total := weight[text[i : i + size]] + best[i + size]) > most:
                    most, step[i] = total, size
            best[i] = most
        out, i = [], 0
        while i < n:
            out.append(text[i : i + step[i]])
            i += step[i]
        return out

    def mp(self, text: str, longest: int = LONGEST) -> list[str]:
        out: list[str] = []
        for may, part in self.lexicon.parts(text):
            out += self._longest_path(part, longest) if may else part
        return out

    def small(self, text: str, longest: int) -> list[str]:
        return self.mp(text, longest)

    def hmm(self, text: str) -> list[str]:
        return self.markov.pieces(text)

    def _mixed(self, words: Iterable[str]) -> list[str]:
        out, loose = [], ""
        for w in words:
            if len(w) == 1 and w not in self.lexicon.user and not BREAKS.match(w) and self.markov:
                loose += w
                continue
            out += (self.markov.cut(loose) if loose else []) + [w]
            loose = ""
        return out + (self.markov.cut(loose) if loose else [])

    def _mixtures(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(whether words of the dictionary may be in it, mix) of each part of a text; separators between parts stand alone."""
        alone = any(len(w) == 1 for w in self.lexicon.user)
        for may, part in self.lexicon.parts(text):
            if may:
                yield may, self._mixed(self._longest_path(part, LONGEST))
            elif self.markov and not alone:
                yield may, self.markov.pieces(part)
            else:
                yield may, self._mixed(part)

    def mix(self, text: str) -> list[str]:
        """Dictionary path, then the model over runs of single characters that the user's dictionary does not hold."""
        return [w for _, words in self._mixtures(text) for w in words]

    def search(self, text: str) -> list[str]:
        """mix, with the two- and three-character words inside longer ones put before them."""
        out = []
        for may, words in self._mixtures(text):
            if not may:
                out += words
                continue
            for w in words:
                for size in (2, 3):
                    if len(w) > size:
                        out += [w[i : i + size] for i in range(len(w) - size + 1) if w[i : i + size] in self.lexicon.weight]
                out.append(w)
        return out

    def full(self, text: str) -> list[str]:
        """Every dictionary word; characters that no word covers stand alone."""
        out = []
        for may, run in self.lexicon.parts(text):
            if not may:
                out += run
                continue
            reach = 0
            for i, sizes in enumerate(self.lexicon.starting(run)):
                words = [run[i : i + n] for n in sizes if n > 1]
                if not words and i >= reach:
                    words = [run[i]]
                out += words
                reach = max([reach, *(i + len(w) for w in words)])
        return out

    def tags(self, text: str) -> list[tuple[str, str]]:
        rule = lambda w: "x" if not _ANY_ASCII.search(w) else "m" if w.isdigit() else "eng"
        tag = self.lexicon.tag.get
        return [(w, tag(w) or rule(w)) for w in self.mix(text)]

    def tokens(self, text: str, stop: frozenset[str] = frozenset()) -> list[str]:
        without = _BLANK | stop
        return [w for w in self.search(text) if w not in without]


def slices(rows: pa.RecordBatch | pa.Array, name: str | None = None, most: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Array]:
    """Rows in parts whose texts have about `most` bytes, lists as many elements by eight, and one row at least: a task turns one part
    into Python objects at a time, however many rows an Arrow batch has."""
    column = rows if name is None else rows[name]
    listed = pa.types.is_list(column.type)
    sizes = pc.fill_null(pc.list_value_length(column) if listed else pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes * 8 if listed else sizes)
    at = 0
    while at < len(ends):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield rows.slice(at, stop - at)
        at = stop


def textrank(words: list[str], span: int = 5, rounds: int = 10, damping: float = 0.85) -> dict[str, float]:
    """Weights of the co-occurrence graph's nodes after in-place rounds in sorted order, rescaled by minimum and maximum."""
    edges: dict[str, dict[str, float]] = {}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + span]:
            if a != b:
                for x, y in ((a, b), (b, a)):
                    edges.setdefault(x, {})
                    edges[x][y] = edges[x].get(y, 0.0) + 1
    if not edges:
        return {}
    out = {w: sum(e.values()) for w, e in edges.items()}
    score = dict.fromkeys(edges, 1.0 / len(edges))
    for _ in range(rounds):
        for w in sorted(edges):
            score[w] = (1 - damping) + damping * sum(v / out[x] * score[x] for x, v in edges[w].items())
    low, high = min(score.values()), max(score.values())
    return {w: (s - low / 10) / (high - low / 10) for w, s in score.items()}


def textranks(docs: np.ndarray, words: pa.Array, span: int = 5, rounds: int = 10, damping: float = 0.85) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """textrank of many texts at once: (docs, words, weights), each text's words by weight, then in the words' order.

    docs: of each word its text's number, ascending; words: the words of all texts, in order. Words that no edge leads to
    have no weight. A round takes the words of a text in order, so a word waits for its smaller neighbours only: words are
    put in levels by the longest way up to them, and a level is one step for all texts.
    """
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = max(len(order), 1)
    keys, token = np.unique(docs.astype(np.int64) * width + rank[coded.indices.to_numpy()], return_inverse=True)
    pairs = []
    for d in range(1, span):
        a, b = token[:-d], token[d:]
        near = (docs[:-d] == docs[d:]) & (a != b)
        pairs.append(np.minimum(a, b)[near] * len(keys) + np.maximum(a, b)[near])
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    low, high = np.divmod(pairs, max(len(keys), 1))
    n = len(keys)
    out = np.bincount(low, times, n) + np.bincount(high, times, n)
    # The longest way up: each turn settles the words whose smaller neighbours are all settled.
    level, waits = np.zeros(n, np.int64), np.bincount(high, minlength=n)
    at = np.searchsorted(low, np.arange(n + 1))
    now, turn = np.flatnonzero(waits == 0), 0
    while len(now):
        level[now] = turn
        counts = at[now + 1] - at[now]
        reached = high[np.repeat(at[now] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        reached, less = np.unique(reached, return_counts=True)
        waits[reached] -= less
        now, turn = reached[waits[reached] == 0], turn + 1
    to, of, count = np.concatenate([low, high]), np.concatenate([high, low]), np.concatenate([times, times]).astype(float)
    by = np.lexsort((to, level[to]))
    to, of, share = to[by], of[by], (count / out[np.concatenate([high, low])])[by]
    begin = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, np.int64)
    nodes = to[begin]
    steps = np.append(np.searchsorted(level[nodes], np.arange(turn)), len(nodes))
    edges = np.append(begin, len(to))[steps]
    linked = out > 0
    owner = keys // width
    size = np.bincount(owner, linked, int(docs[-1]) + 1 if len(docs) else 0)
    score = 1.0 / np.maximum(size, 1)[owner]
    # Terms are added in two parts, multiples of 2^-30 without any rounding and the small rest, so sums do not hang on order.
    plan = [(nodes[i:j], of[e:f], share[e:f], begin[i:j] - e) for i, j, e, f in zip(steps[:-1], steps[1:], edges[:-1], edges[1:], strict=True) if i < j]
    grid = 1.5 * 2.0**22
    for _ in range(rounds):
        for node, source, part, where in plan:
            terms = part * score[source]
            coarse = (terms + grid) - grid
            score[node] = (1 - damping) + damping * (np.add.reduceat(coarse, where) + np.add.reduceat(terms - coarse, where))
    nodes = np.flatnonzero(linked)
    owner, score = owner[nodes], score[nodes]
    if len(nodes):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        repeats = np.diff(np.append(first, len(owner)))
        least, most = (np.repeat(f.reduceat(score, first), repeats) for f in (np.minimum, np.maximum))
        score = (score - least / 10) / (most - least / 10)
    best = np.lexsort((nodes, -score, owner))
    return owner[best], coded.dictionary.take(pa.array(order[keys[nodes] % width][best])), score[best]


def keywords(words: list[str], idf: dict[str, float], top_n: int, stop: frozenset[str] = frozenset()) -> list[tuple[str, float]]:
    """Term frequency times idf, the mean idf for unknown words; single characters and stop words do not count."""
    mean = sum(idf.values()) / len(idf) if idf else 1.0
    counts: dict[str, int] = {}
    for w in words:
        if len(w) > 1 and w not in stop:
            counts[w] = counts.get(w, 0) + 1
    return sorted(((w, n * idf.get(w, mean)) for w, n in counts.items()), key=lambda x: (-x[1], x[0]))[:top_n]


def fnv1a(data: bytes) -> str:
    """The 64-bit FNV-1a hash in hexadecimal."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
