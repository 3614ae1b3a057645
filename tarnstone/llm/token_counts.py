"""Operator 5, token counts: byte-pair merging with a heap and a linked list, counting tokens without making identifiers."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnstone.llm.common import read_table

MODEL = "piece_bpe_32k.model"
#: Tokens above which a document counts as over the limit.
LIMIT = 4096
#: Word counts that a worker remembers; the memory is emptied when full, results do not depend on it.
CACHE_WORDS = 400_000
LONG_WORD = 64
SPACE = "▁"


class PieceCounter:
    """Counts the pieces of a text as the library's byte-pair model with byte fallback gives them.

    No piece has the space mark after another character and none has a line feed (checked on loading), so that a text
    falls apart into words that never merge with each other, and a word's count can be remembered.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.breaks = "\n" if not any("\n" in p for p in self.rank) else None
        counter = self

        class Known(dict):
            def __init__(self, prefix: str):
                self.prefix = prefix

            def __missing__(self, word: str) -> int:
                n = counter.merge(self.prefix + word)
                if len(word) <= LONG_WORD:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[word] = n
                return n

        self.marked, self.bare = Known(SPACE), Known("")

    def merge(self, text: str) -> int:
        """Initial symbols minus merges; a symbol outside the vocabulary counts its UTF-8 bytes."""
        rank, symbols = self.rank, list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j] = made, ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(made + symbols[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, made + symbols[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + made)
                if r is not None:
                    heapq.heappush(heap, (r, h, symbols[h] + made))
        return count + sum(len(s.encode()) - 1 for s in symbols if s and s not in rank)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if not self.splits:
            return self.merge((" " + text).replace(" ", SPACE))
        parts = text.split(" ")
        if "" in parts:
            return self._spaced(text)
        if self.breaks and self.breaks in text:
            n, marked, bare = 0, self.marked, self.bare
            for part in parts:
                if "\n" in part:
                    first, *rest = part.split("\n")
                    n += marked[first] + len(rest) + sum(bare[x] for x in rest if x)
                else:
                    n += marked[part]
            return n
        return sum(map(self.marked.__getitem__, parts))

    def _spaced(self, text: str) -> int:
        n = 0
        for m in re.finditer(" *[^ ]+| +$", " " + text):
            run = m.group()
            word = run.lstrip(" ")
            gaps = len(run) - len(word)
            if gaps == 1:
                first, *rest = word.split("\n") if self.breaks else [word]
                n += self.marked[first] + len(rest) + sum(self.bare[x] for x in rest if x)
            else:
                n += self.merge(SPACE * gaps + word)
        return n


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens; repeated rows are counted each; a null doc_id stays null. Very long
    words take n log n steps. Columns other than the two named are not looked at. An empty table gives an empty one.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(model_path)
        for s in texts:
            yield pd.Series([counter(x) for x in s], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
