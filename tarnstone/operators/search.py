"""Inverted index and BM25 ranking as relational operators.

An index is four tables: postings (term, doc_id, tf), doc_stats (doc_id, dl), terms (term, df, idf) and corpus_stats
(n, avg_dl). A search touches the postings of its own terms only, and looks contents up after the top rows are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnstone.functions.segment import slices
from tarnstone.functions.text import TOKEN, identifier_score, looks_english, path_score, tokenize_en
from tarnstone.sources.files import stored

K1, B = 1.5, 0.75
UNLIMITED = 64


def counted(tokens: Column) -> Column:
    """Of lists of tokens, none null: dl, their length, and their distinct tokens laid end to end (terms), with the bytes of each
    (sizes) and how often it occurs (tfs), both as 32-bit numbers."""

    def count(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([_counted(some) for some in slices(lists, most=1 << 24)] or [_counted(lists)])

    return F.arrow_udf(count, "struct<dl int, terms binary, sizes binary, tfs binary>")(tokens)


def _counted(tokens: pa.Array) -> pa.Array:
    coded = tokens.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    keys, tf = np.unique(pc.list_parent_indices(tokens).to_numpy().astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(keys, width)
    terms = coded.dictionary.take(pa.array(code))
    sizes = pc.binary_length(terms).to_numpy()
    at = np.searchsorted(row, np.arange(len(tokens) + 1))
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    columns = [(ends[at], terms.buffers()[2]), (at * 4, pa.py_buffer(sizes.astype("<i4"))), (at * 4, pa.py_buffer(tf.astype("<i4")))]
    laid = [pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(offsets.astype(np.int32)), body]) for offsets, body in columns]
    return pa.StructArray.from_arrays([pc.list_value_length(tokens), *laid], ["dl", "terms", "sizes", "tfs"])


def _numbers(column: pa.Array) -> np.ndarray:
    """The 32-bit numbers of all rows of a column that begins at its buffer's start."""
    n = pc.sum(pc.binary_length(column)).as_py() or 0
    return np.frombuffer(column.buffers()[2], "<i4", n // 4) if n else np.empty(0, "<i4")


def laid_out(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, tf) of all terms of rows with the columns terms, sizes and tfs of counted, which begin at their buffers' start."""
    sizes, tf = _numbers(rows["sizes"]), _numbers(rows["tfs"])
    row = np.repeat(np.arange(len(rows)), pc.binary_length(rows["sizes"]).to_numpy() // 4)
    offsets = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return row, pa.Array.from_buffers(pa.string(), len(sizes), [None, offsets, rows["terms"].buffers()[2]]), tf


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, "terms", 1 << 24):
            some = some.take(pa.array(np.arange(len(some))))
            row, term, tf = laid_out(some)
            if len(row):
                yield pa.RecordBatch.from_arrays([term, some["doc_id"].take(pa.array(row)), pa.array(tf.astype(np.int64))], ["term", "doc_id", "tf"])


@dataclass
class Index:
    """tokens: what the postings and lengths come from (doc_id, tokens), where it is known."""

    postings: DataFrame
    doc_stats: DataFrame
    terms: DataFrame
    corpus: DataFrame
    tokens: DataFrame | None = None

    def save(self, path: str) -> None:
        """postings are ranged and sorted by term, so that a search reads the row groups of its terms. Texts are cut once: the
        terms of each are counted where they are cut, and written; postings and lengths are read from there. What follows from
        these is counted from them as they were written."""
        postings, stats = self.postings, self.doc_stats
        if self.tokens is not None:
            said = stored(self.tokens.select("doc_id", counted(F.col("tokens")).alias("said")).select("doc_id", "said.*"), "index-terms")
            key = said.schema["doc_id"].dataType.simpleString()
            each = said.select("doc_id", "terms", "sizes", "tfs").mapInArrow(_postings, f"term string, doc_id {key}, tf long")
            stats = said.select("doc_id", F.col("dl").cast("long").alias("dl"))
            # Rows of one doc_id are one document of the postings; a term's rows lie in one range.
            postings = each.repartitionByRange("term").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")).sortWithinPartitions("term", "doc_id")
        else:
            postings = postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id")
        postings.write.mode("overwrite").parquet(f"{path}/postings")
        stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        read = self.postings.sparkSession.read
        corpus_of(read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/corpus")
        terms_of(read.parquet(f"{path}/postings"), read.parquet(f"{path}/corpus")).write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "doc_stats", "terms", "corpus")])


def idf_of(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def with_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tokens; a null text has none."""
    return docs.select(F.col(key).alias("doc_id"), tokenize_en(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    tokens = with_tokens(docs, text, key)
    postings = term_frequency(tokens).select("term", "doc_id", "tf")
    stats = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"))
    corpus = corpus_of(stats)
    return Index(postings, stats, terms_of(postings, corpus), corpus, tokens)


def corpus_of(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))


def terms_of(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", idf_of(corpus.select("n").scalar(), F.col("df")).alias("idf"))


def unique(tokens: list[str]) -> list[str]:
    return [t for t in dict.fromkeys(tokens) if t]


def matched(docs: DataFrame, terms: list[str], text: str = "text", key: str = "doc_id", parts: list[str] | None = None) -> DataFrame:
    """Postings of the query's terms straight from the documents: (*parts, doc_id, term, tf, dl, df, n, avg_dl).

    Texts are cut twice: for the statistics, one row a part, in which each term of the query is counted, and for the hits,
    which are told without a shuffle. A row is a document of its own.
    """
    hits = _matched(docs, terms, text, key, parts)
    return hits if parts else hits.drop("dfs")


def _matched(docs: DataFrame, terms: list[str], text: str, key: str, parts: list[str] | None) -> DataFrame:
    """matched, without parts also with dfs, the document frequencies of all terms."""
    parts, terms = parts or [], terms or [""]
    rows = docs.select(*parts, F.col(key).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    told = F.transform(F.filter("tokens", lambda t: (F.octet_length(t) <= max(map(len, terms))) & F.lower(t).isin(terms)), F.lower)
    rows = rows.select(*parts, "doc_id", F.size("tokens").cast("long").alias("dl"), told.alias("hits"))
    df = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*[F.count_if(F.array_contains("hits", t)) for t in terms]))
    stats = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"), df.alias("dfs"))
    counted = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).cast("long").alias("tf")))
    # A filter on the lists would be put before they are told, and texts be cut for it once more; one on the terms is not.
    hits = rows.select(*parts, "doc_id", "dl", F.inline_outer(counted)).filter("term IS NOT NULL")
    if parts:
        return hits.join(stats, parts).withColumn("df", F.element_at("dfs", F.col("term"))).drop("dfs")
    known = hits.withColumn("stats", stats.select(F.struct("n", "avg_dl", "dfs")).scalar())
    return known.select("doc_id", "term", "tf", "dl", F.element_at("stats.dfs", F.col("term")).alias("df"), "stats.n", "stats.avg_dl", "stats.dfs")


def weight() -> Column:
    return idf_of(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))


def posting_cap(capped: DataFrame) -> DataFrame:
    """The first postings of each term in document order: fewer for common terms and for short or uninformative ones."""
    low = (F.octet_length("term") <= 3) | (idf_of(F.col("n"), F.col("df")) < 0.12)
    common = F.col("df") > F.floor(F.col("n") / 3)
    cap = F.when(common & low, 256).when(common | low, 1024).otherwise(4096)
    return capped.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter(F.col("at") <= cap).drop("at")


def bm25(docs: DataFrame, query: list[str], top_k: int = -1, cap: bool = False, text: str = "text", key: str = "doc_id", parts: list[str] | None = None) -> DataFrame:
    """(*parts, doc_id, score), best first, ties by doc_id; top_k <= 0 gives all hits."""
    hits = matched(docs, unique(query), text, key, parts)
    hits = posting_cap(hits) if cap else hits
    out = hits.groupBy(*(parts or []), "doc_id").agg(F.sum(weight()).alias("score"))
    return top(out, top_k) if not parts else out


def top(scored: DataFrame, top_k: int, tie: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), tie).limit(top_k) if top_k > 0 else scored


def query_index(index: Index, query: list[str], top_k: int = -1) -> DataFrame:
    """The same ranking from a stored index: the filter on terms reaches the scan of the postings."""
    terms = unique(query)
    hits = index.postings.filter(F.col("term").isin(terms)).join(F.broadcast(index.terms.filter(F.col("term").isin(terms))), "term").join(index.doc_stats, "doc_id")
    hits = hits.withColumns({"n": index.corpus.select("n").scalar(), "avg_dl": index.corpus.select("avg_dl").scalar()})
    return top(hits.groupBy("doc_id").agg(F.sum(weight()).alias("score")), top_k)


def fallback(primary: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of primary, or where it has none those of second, decided in the plan by a count of one row at most."""
    some = primary.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return primary.withColumn("phase", F.lit(1)).unionByName(second.filter(some == 0).withColumn("phase", F.lit(2)))


def bm25_fallback(docs: DataFrame, first: list[str], second: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score, phase: all hits of the first query, or where it has none those of the second. Texts are cut for both at once."""
    first, second = unique(first) or [""], unique(second) or [""]
    hits = _matched(docs, unique([*first, *second]), text, key, None)
    some = F.greatest(F.lit(0), *[F.coalesce(F.try_element_at("dfs", F.lit(t)), F.lit(0)) for t in first]) > 0
    hits = hits.filter(F.when(some, F.col("term").isin(first)).otherwise(F.col("term").isin(second)))
    return hits.groupBy("doc_id", F.when(some, 1).otherwise(2).alias("phase")).agg(F.sum(weight()).alias("score")).select("doc_id", "score", "phase")


def search_all(docs: DataFrame, bucket: str, query: list[str], top_k: int) -> DataFrame:
    """Each bucket's best max(3k, 30) (60 without a limit), put together by raw score and cut to k."""
    each = max(3 * top_k, 30) if top_k > 0 else 60
    scored = bm25(docs, query, parts=[bucket])
    best = Window.partitionBy(bucket).orderBy(F.desc("score"), "doc_id")
    kept = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= each).drop("rank")
    return top(kept, top_k)


def search_identifiers(rows: DataFrame, column: str, query: str, top_k: int) -> DataFrame:
    """Prefix hits before substring hits, each by score and then name."""
    scored = rows.withColumn("score", identifier_score(F.col(column), query)).filter("score IS NOT NULL")
    tier = F.when(F.startswith(F.lower(column), F.lit(query.lower())), 1).otherwise(2)
    return scored.withColumn("tier", tier).orderBy("tier", F.desc("score"), column).limit(top_k)


def first_line_with(text: Column, query: list[str], most: int = 160) -> Column:
    """The first line that has a term of the query in any case, trimmed and cut; empty if none has."""
    any_of = "|".join("".join(c if c.isalnum() else f"\\{c}" for c in t) for t in unique(query)) or "(?!)"
    line = F.get(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?i){any_of}")), F.lit(0))
    return F.left(F.trim(F.coalesce(line, F.lit(""))), F.lit(most))


def search_assets(rows: DataFrame, keyword: str, query: list[str], top_k: int, path: str = "path", content: str = "content", snippet: bool = False) -> DataFrame:
    """path, score: content score plus path score, paths with either. snippet: also the first line that matches, looked up
    after the best are known."""
    by_content = top(bm25(rows, query, text=content, key=path), 4 * top_k if top_k > 0 else 800).select(F.col("doc_id").alias(path), F.col("score").alias("s1"))
    by_path = rows.select(path, path_score(F.col(path), keyword, query).alias("s2")).filter("s2 > 0")
    both = by_content.groupBy(path).agg(F.sum("s1").alias("s1")).join(by_path.groupBy(path).agg(F.max("s2").alias("s2")), path, "full_outer")
    scored = both.select(path, (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("score"))
    best = top(scored, top_k if top_k > 0 else 200, path)
    if not snippet:
        return best
    shown = rows.join(F.broadcast(best), path).select(path, "score", first_line_with(F.col(content), [*query, keyword]).alias("snippet"))
    return shown.orderBy(F.desc("score"), path)


def query_tokens(text: str, mode: str = "auto", second: bool = False, chinese=None) -> list[str]:
    """The tokens of a query: English for ASCII text, else the Chinese segmenter's, or English where that finds none."""
    import re

    english = [t.lower() for t in re.findall("[A-Za-z0-9_]+", text)]
    plain = text.isascii() and bool(re.search("[A-Za-z0-9_]", text))
    if mode == "english" or (mode == "auto" and plain) or (mode == "prefer_english_fallback" and second):
        return english
    return (chinese(text) if chinese else []) or english


#: So many of the commonest terms have their document counts sent to all tasks.
COMMON = 65536


def tfidf_keywords(docs: DataFrame, top_n: int, common: int = COMMON) -> DataFrame:
    """doc_id, term, weight, rank: term frequency times idf, best top_n of each document, ties by term. Single letters do not count.

    Texts are shuffled once, whole, by document. The commonest terms are weighed where they are counted, and only the best
    top_n of them in a document go on; only the rows of all other terms are shuffled to their counts.
    """
    tf = term_frequency(with_tokens(docs.select("doc_id", "text").repartition("doc_id"))).filter(F.length("term") > 1)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    known = F.broadcast(df.orderBy(F.desc("df"), "term").limit(common))
    best = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n)

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "term", F.round(F.col("tf") * idf_of(n, F.col("df")), 6).alias("weight"))

    first = ranked(weighed(tf.join(known, "term"))).drop("rank")
    rest = weighed(tf.join(known.select("term"), "term", "left_anti").join(df, "term"))
    return ranked(first.unionByName(rest)).select("doc_id", "term", "weight", F.col("rank").cast("long").alias("rank"))


__all__ = ["Index", "bm25", "bm25_fallback", "build_index", "fallback", "looks_english", "matched", "query_index", "query_tokens", "search_all", "search_assets", "search_identifiers", "tfidf_keywords", "top"]
