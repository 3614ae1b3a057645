"""Queries with Arrow UDFs: segmentation, graph keywords, index files."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.functions import segment as G
from tarnstone.functions.text import tokenize_en
from tarnstone.operators import search as S
from tarnstone.operators.knowledge import Knowledge, chinese, impact, posting_blocks
from tarnstone.plans.base import QUERIES, query, shared_folder, table

#: A small dictionary and model for the queries; users bring their own.
WORDS = ["今天 900 t", "天气 800 n", "很好 700 a", "我们 950 r", "实体 500 n", "组件 400 n", "实体组件 60 n", "渲染 300 v", "控制器 200 n", "控制 350 v"]
PHRASES = ["今天天气很好", "我们渲染实体组件", "控制器abc123，实体", "龙与地下城"]


def model() -> G.Markov:
    log = math.log
    return G.Markov([log(0.6), G.LOWEST, G.LOWEST, log(0.4)], [[G.LOWEST, log(0.7), log(0.3), G.LOWEST], [log(0.6), G.LOWEST, G.LOWEST, log(0.4)], [G.LOWEST, log(0.7), log(0.3), G.LOWEST], [log(0.6), G.LOWEST, G.LOWEST, log(0.4)]], [dict.fromkeys("今天我们控实", -1.0), dict.fromkeys("天气好件器体", -1.0), dict.fromkeys("制组", -1.5), dict.fromkeys("很与龙", -1.0)])


def segmented(docs: DataFrame, how: str) -> DataFrame:
    """doc_id, words of a phrase put before the start of each text."""

    def cut(parts):
        s = G.Segmenter(G.Lexicon.parse(WORDS), model())
        call = {"seg_mp": s.mp, "seg_hmm": s.hmm, "seg_mix": s.mix, "seg_search": s.search, "seg_full": s.full, "seg_small": lambda t: s.small(t, 2), "tokenize_cn": s.tokens, "seg_tags": lambda t: [f"{w}/{k}" for w, k in s.tags(t)]}[how]
        for batch in parts:
            for some in G.slices(batch, "text"):
                words = pa.array(["|".join(call(t)) for t in some["text"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([some["doc_id"], words], ["doc_id", "words"])

    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return docs.filter("text IS NOT NULL").select("doc_id", F.concat(phrase, F.lit(" "), F.col("text")).alias("text")).mapInArrow(cut, "doc_id long, words string")


for _how in ("seg_mp", "seg_hmm", "seg_mix", "seg_search", "seg_full", "seg_small", "tokenize_cn", "seg_tags"):

    @query(_how)
    def _(docs, how=_how):
        return segmented(docs, how)


@query("textrank_keywords")
def _(docs):
    """doc_id, word, weight of each text's five best words."""

    def ranked(parts):
        for batch in parts:
            for some in G.slices(batch, "words"):
                words = some["words"]
                row, word, weight = G.textranks(pc.list_parent_indices(words).to_numpy(), words.flatten())
                place = np.arange(len(row)) - np.searchsorted(row, row)
                five = pa.array(np.flatnonzero(place < 5))
                weights = pa.array([round(v, 6) for v in weight[place < 5].tolist()], pa.float64())
                yield pa.RecordBatch.from_arrays([some["doc_id"].take(pa.array(row[place < 5])), word.take(five), weights], ["doc_id", "word", "weight"])

    return docs.filter("text IS NOT NULL").select("doc_id", tokenize_en(F.col("text")).alias("words")).mapInArrow(ranked, "doc_id long, word string, weight double")


@query("dict_lookup", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents)
SELECT word, word IN ('the', 'and', 'of', 'de') AS known, word IN ('the', 'de') AS own FROM w""")
def _(docs):
    """The distinct words of all texts, looked up in a dictionary that has had words inserted and deleted."""

    def looked_up(parts):
        lexicon = G.Lexicon.parse(["the 100 d", "and 50 c", "of 25 p", "la 10 d", "to 5 p"])
        lexicon.insert("the"), lexicon.insert("de", 7.0, "p")
        lexicon.delete("la"), lexicon.delete("to"), lexicon.delete("no such word")
        for pdf in parts:
            yield pdf.assign(known=[lexicon.find(w) for w in pdf["word"]], own=[lexicon.find(w) and w in lexicon.user for w in pdf["word"]])

    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("word")).distinct()
    return words.mapInPandas(looked_up, "word string, known boolean, own boolean")


FNV = """lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::HUGEINT)),
lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')"""


@query("fingerprint_fnv", f"SELECT p_partkey, {FNV} AS hash FROM (SELECT p_partkey, p_name || ':' || p_size AS s FROM part)", "part")
def _(part):
    """The fingerprint by which a watcher sees that a file (here a part's name and size) has changed."""
    said = part.select("p_partkey", F.concat_ws(":", "p_name", F.col("p_size").cast("string")).alias("s"))
    return said.mapInPandas(lambda parts: (pd.DataFrame({"p_partkey": p["p_partkey"], "hash": [G.fnv1a(x.encode()) for x in p["s"]]}) for p in parts), "p_partkey long, hash string")


def _index_folder(spark) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _index_restore(spark, sf_dir):
    """An index written and read back gives the ranking of bm25_topk."""
    from tarnstone.plans.q_search import WORDS as TERMS

    folder = _index_folder(spark)
    S.build_index(table(spark, sf_dir, "documents")).save(folder)
    return S.query_index(S.Index.load(spark, folder), TERMS, 20).select("doc_id", F.round("score", 6).alias("score"))


def _index_save(spark, sf_dir):
    """part, rows of the index tables as written."""
    folder = _index_folder(spark)
    S.build_index(table(spark, sf_dir, "documents")).save(folder)
    loaded = S.Index.load(spark, folder)
    one = lambda name: getattr(loaded, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
    return one("postings").unionByName(one("doc_stats")).unionByName(one("terms")).unionByName(one("corpus"))


def _fragments(docs: DataFrame) -> DataFrame:
    """The documents as fragments: a source is a file, a language a category."""
    return docs.select("doc_id", F.col("source").alias("file"), F.col("lang").alias("category"), F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"), F.col("text").alias("content"))


def _indexed(index: Knowledge, fragments: DataFrame) -> Knowledge:
    """Refreshes the index with fragments: a file's length is its rows' number, its time the sum of their lengths."""
    files = fragments.groupBy(F.col("file").alias("path")).agg(F.sum(F.length("content")).alias("modified"), F.count(F.lit(1)).alias("length")).filter("path IS NOT NULL")
    index.refresh(files, lambda paths: fragments.join(paths.withColumnRenamed("path", "file"), "file", "left_semi"))
    return index


def _index_refreshed(spark, sf_dir):
    """The ranking of search_wiki from an index first written without the labelled documents and then refreshed with all."""
    from tarnstone.plans.q_search import WORDS as TERMS

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = Knowledge(spark, _index_folder(spark))
    _indexed(index, _fragments(docs.join(labels.select("doc_id"), "doc_id", "left_anti")))
    return _indexed(index, _fragments(docs)).search("en", TERMS, 6).select("doc_id", F.round("score", 6).alias("score"))


def _posting_blocks(spark, sf_dir):
    """category, term, n, first, last of each term's blocks put together, and whether each holds 64 postings at most, in order."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(F.col("lang").alias("category"), "doc_id", tokenize_en(F.coalesce("text", F.lit(""))).alias("tokens"))
    postings = tokens.select("category", "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("category", "term", "doc_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    blocks = posting_blocks(postings.withColumn("impact", impact(F.lit(100.0))), 64)
    right = (F.col("n") <= 64) & (F.size("docs") == F.col("n")) & (F.sort_array("docs") == F.col("docs")) & (F.element_at("docs", 1) == F.col("first")) & (F.element_at("docs", -1) == F.col("last"))
    sums = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences"), F.min(right).alias("whole")]
    return blocks.groupBy("category", "term").agg(*sums)


def _search_cn(spark, sf_dir):
    """Texts behind a Chinese phrase each, ranked by content through the segmenter's index."""
    segmenter = G.Segmenter(G.Lexicon.parse(WORDS), model())
    docs = table(spark, sf_dir, "documents")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    rows = _fragments(docs.withColumn("text", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")))).withColumn("lang", F.lit("Guide")))
    index = _indexed(Knowledge(spark, _index_folder(spark), {"Guide": chinese(spark, segmenter)}), rows)
    return index.search("Guide", segmenter.tokens("渲染实体组件"), 20).select("doc_id", F.round("score", 6).alias("score"))


def _resource_list(spark, sf_dir):
    """name, bytes of the files of a folder, as the resource reader sees them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/nation.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


from tarnstone.plans.base import ORACLE_SQL  # noqa: E402
from tarnstone.plans.q_search import BASE, HITS, W  # noqa: E402

QUERIES["index_restore"] = _index_restore
ORACLE_SQL["index_restore"] = f"{BASE}, {HITS} SELECT doc_id, round(sum({W}), 6) AS score FROM h GROUP BY doc_id ORDER BY sum({W}) DESC, doc_id LIMIT 20"
QUERIES["index_save"] = _index_save
ORACLE_SQL["index_save"] = f"{BASE} SELECT 'postings' AS part, count(*) AS rows FROM p UNION ALL SELECT 'doc_stats', count(*) FROM s UNION ALL SELECT 'terms', count(*) FROM f UNION ALL SELECT 'corpus', 1"
QUERIES["index_refreshed"] = _index_refreshed
ORACLE_SQL["index_refreshed"] = ORACLE_SQL["search_wiki"]
QUERIES["posting_blocks"] = _posting_blocks
ORACLE_SQL["posting_blocks"] = f"{BASE} SELECT lang AS category, term, count(*) AS n, min(p.doc_id) AS first, max(p.doc_id) AS last, CAST(sum(tf) AS BIGINT) AS occurrences, true AS whole FROM p JOIN s USING (doc_id) GROUP BY lang, term"
QUERIES["search_cn"] = _search_cn
QUERIES["resource_list"] = _resource_list
