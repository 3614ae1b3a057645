"""Queries over the inverted index: statistics, ranking and its variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.operators import search as S
from tarnstone.plans.base import query
from tarnstone.plans.q_text import PATH, TOKENS, path_of

WORDS = ["the", "thble", "onthe", "ing", "est", "tion"]
LIST = "('" + "', '".join(WORDS) + "')"
T_ = f"t AS (SELECT doc_id, lang, {TOKENS} AS tokens FROM documents)"
S_ = "s AS (SELECT doc_id, lang, CAST(coalesce(len(tokens), 0) AS BIGINT) AS dl FROM t)"
P_ = "p AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS w FROM t) GROUP BY ALL)"
C_ = "c AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM s)"
F_ = "f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
W = f"{IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))"
BASE = f"WITH {T_}, {S_}, {P_}, {C_}, {F_}"
HITS = f"h AS (SELECT p.doc_id, p.term, s.lang, tf, dl, df, n, avg_dl FROM p JOIN f USING (term) JOIN s USING (doc_id), c WHERE term IN {LIST})"


def six(df, *keys):
    return df.select(*keys, F.round("score", 6).alias("score"))


@query("term_frequency", f"{BASE} SELECT doc_id, term, tf FROM p")
def _(docs):
    return S.term_frequency(S.with_tokens(docs))


@query("doc_length", f"WITH {T_}, {S_} SELECT doc_id, dl FROM s")
def _(docs):
    return S.with_tokens(docs).select("doc_id", F.size("tokens").cast("long").alias("dl"))


@query("corpus_stats", f"{BASE} SELECT n, round(avg_dl, 6) AS avg_dl FROM c")
def _(docs):
    return S.build_index(docs).corpus.select("n", F.round("avg_dl", 6).alias("avg_dl"))


@query("document_frequency", f"{BASE} SELECT term, df FROM f")
def _(docs):
    return S.build_index(docs).terms.select("term", "df")


@query("idf", f"{BASE} SELECT term, round({IDF}, 6) AS idf FROM f, c")
def _(docs):
    return S.build_index(docs).terms.select("term", F.round("idf", 6).alias("idf"))


def posting_lists(p):
    said = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("tf").cast("string")).alias("said")
    return p.groupBy("term").agg(F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", said)))["said"], " ").alias("postings"))


@query("inverted_index", f"{BASE} SELECT term, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM p GROUP BY term")
def _(docs):
    return posting_lists(S.build_index(docs).postings)


@query("postings_lookup", f"{BASE}, {HITS} SELECT doc_id, term, tf, dl, df FROM h")
def _(docs):
    return S.matched(docs, WORDS).select("doc_id", "term", "tf", "dl", "df")


@query("bm25_search", f"{BASE}, {HITS} SELECT doc_id, round(sum({W}), 6) AS score FROM h GROUP BY doc_id")
def _(docs):
    return six(S.bm25(docs, WORDS), "doc_id")


@query("bm25_topk", f"{BASE}, {HITS} SELECT doc_id, round(sum({W}), 6) AS score FROM h GROUP BY doc_id ORDER BY sum({W}) DESC, doc_id LIMIT 20")
def _(docs):
    return six(S.bm25(docs, WORDS, 20), "doc_id")


CAP = f"CASE WHEN df > floor(n / 3) AND (strlen(term) <= 3 OR {IDF} < 0.12) THEN 256 WHEN df > floor(n / 3) OR strlen(term) <= 3 OR {IDF} < 0.12 THEN 1024 ELSE 4096 END"


@query("bm25_capped", f"{BASE}, {HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS pos FROM h) SELECT doc_id, round(sum({W}), 6) AS score FROM k WHERE pos <= {CAP} GROUP BY doc_id")
def _(docs):
    return six(S.bm25(docs, WORDS, cap=True), "doc_id")


PART = f"""WITH t AS (SELECT doc_id, lang, {TOKENS} AS tokens FROM documents WHERE lang = 'en'), {S_}, {P_}, {C_}, {F_}, {HITS}"""


@query("search_wiki", f"{PART} SELECT doc_id, round(sum({W}), 6) AS score FROM h GROUP BY doc_id ORDER BY sum({W}) DESC, doc_id LIMIT 6")
def _(docs):
    return six(S.bm25(docs.filter("lang = 'en'"), WORDS, 6), "doc_id")


for _name, _lang, _text in (("search_api", "fr", "de in"), ("search_enum", "de", "und der Sch"), ("search_qumod", "es", "que, LA ción"), ("search_guide", "en", "The_The of (erst)")):
    _terms = "('" + "', '".join(dict.fromkeys(S.query_tokens(_text))) + "')"

    @query(_name, f"{PART.replace(chr(39) + 'en' + chr(39), chr(39) + _lang + chr(39)).replace(LIST, _terms)} SELECT doc_id, round(sum({W}), 6) AS score FROM h GROUP BY doc_id ORDER BY sum({W}) DESC, doc_id LIMIT 6")
    def _(docs, lang=_lang, text=_text):
        return six(S.bm25(docs.filter(F.col("lang") == lang), S.query_tokens(text), 6), "doc_id")


@query("search_fallback", f"{BASE}, {HITS} SELECT doc_id, round(sum({W}), 6) AS score, 2 AS phase FROM h GROUP BY doc_id")
def _(docs):
    return S.bm25_fallback(docs, ["nosuchterm"], WORDS).select("doc_id", F.round("score", 6).alias("score"), "phase")


ALL = f"""WITH {T_}, {S_}, {P_}, c AS (SELECT lang, count(*) AS n, avg(dl) AS avg_dl FROM s GROUP BY lang),
f AS (SELECT lang, term, count(*) AS df FROM p JOIN s USING (doc_id) GROUP BY lang, term),
h AS (SELECT p.doc_id, p.term, s.lang, tf, dl, df, n, avg_dl FROM p JOIN s USING (doc_id) JOIN f USING (term, lang) JOIN c USING (lang) WHERE term IN {LIST}),
r AS (SELECT lang, doc_id, sum({W}) AS score FROM h GROUP BY lang, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT lang, doc_id, round(score, 6) AS score FROM k WHERE rank <= 60 ORDER BY k.score DESC, doc_id LIMIT 20"""


@query("search_all", ALL)
def _(docs):
    return six(S.search_all(docs, "lang", WORDS, 20), "lang", "doc_id")


IDENT = """SELECT p_partkey, p_name, CASE WHEN pos = 1 THEN 1000.0 - (length(p_name) - 2) ELSE 600.0 - (pos - 1) END AS score FROM (SELECT p_partkey, p_name, instr(lower(p_name), 'ar') AS pos FROM part) WHERE pos > 0"""


@query("ident_search", f"SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM ({IDENT}) ORDER BY p_partkey", "part")
def _(part):
    return part.withColumn("score", T.identifier_score(F.col("p_name"), "ar")).filter("score IS NOT NULL").select("p_partkey", "score")


@query("search_event", "SELECT s_suppkey, CAST(1000 - (length(s_name) - 10) AS DOUBLE) AS score FROM supplier WHERE lower(s_name) LIKE 'supplier#0%' ORDER BY score DESC, s_name LIMIT 8", "supplier")
def _(supplier):
    return S.search_identifiers(supplier, "s_name", "supplier#0", 8).select("s_suppkey", "score")


KEY, KEYS = "example.net/en", ["example", "net", "en"]
SCORE = f"(CASE WHEN contains(lower(path), '{KEY}') THEN 10 ELSE 0 END" + "".join(f" + CASE WHEN contains(lower(path), '{k}') THEN 3 ELSE 0 END" for k in KEYS) + ")"


@query("path_score", f"SELECT page_id, CAST({SCORE} AS DOUBLE) AS score FROM (SELECT page_id, {PATH} AS path FROM pages)", "pages")
def _(pages):
    return path_of(pages).select("page_id", T.path_score(F.col("path"), KEY, KEYS).alias("score"))


A_IN = "('" + "', '".join(KEYS) + "')"


@query("asset_search", f"""WITH t AS (SELECT page_id AS doc_id, {TOKENS.replace('text', 'html')} AS tokens FROM pages), s AS (SELECT doc_id, CAST(len(tokens) AS BIGINT) AS dl FROM t), {P_}, {C_}, {F_},
h AS (SELECT p.doc_id, sum({W}) AS score FROM p JOIN f USING (term) JOIN s USING (doc_id), c WHERE term IN {A_IN} GROUP BY p.doc_id),
b AS (SELECT doc_id AS page_id, score AS s1 FROM h ORDER BY score DESC, doc_id LIMIT 24),
q AS (SELECT page_id, CAST({SCORE} AS DOUBLE) AS s2 FROM (SELECT page_id, {PATH} AS path FROM pages) WHERE {SCORE} > 0)
SELECT page_id, round(coalesce(s1, 0) + coalesce(s2, 0), 6) AS score FROM b FULL JOIN q USING (page_id) ORDER BY coalesce(s1, 0) + coalesce(s2, 0) DESC, page_id LIMIT 6""", "pages")
def _(pages):
    rows = path_of(pages).select("page_id", "path", "html")
    by_content = S.top(S.bm25(rows, KEYS, text="html", key="page_id"), 24).select(F.col("doc_id").alias("page_id"), F.col("score").alias("s1"))
    by_path = rows.select("page_id", T.path_score(F.col("path"), KEY, KEYS).alias("s2")).filter("s2 > 0")
    both = by_content.join(by_path, "page_id", "full_outer").select("page_id", (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("score"))
    return six(S.top(both, 6, "page_id"), "page_id")


@query("format_hits", f"{BASE}, {HITS}, r AS (SELECT doc_id, sum({W}) AS score FROM h GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 6) SELECT '{{\"type\":\"text\",\"file\":\"' || source || '\",\"doc\":' || doc_id || '}}' AS hit FROM r JOIN documents USING (doc_id)")
def _(docs):
    best = S.bm25(docs, WORDS, 6)
    return docs.join(F.broadcast(best), "doc_id").select(F.to_json(F.struct(F.lit("text").alias("type"), F.col("source").alias("file"), F.col("doc_id").alias("doc"))).alias("hit"))


@query("tfidf_keywords", f"""{BASE}, k AS (SELECT doc_id, term, round(tf * {IDF}, 6) AS weight FROM p JOIN f USING (term), c WHERE length(term) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM k) SELECT doc_id, term, weight, rank FROM r WHERE rank <= 5""")
def _(docs):
    return S.tfidf_keywords(docs, 5)
