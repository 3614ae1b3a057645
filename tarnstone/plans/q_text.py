"""Queries over text: sources, predicates, tokenizers and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.operators import fragments as R
from tarnstone.plans.base import query

TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))"
PATH = "regexp_replace(url, '^[a-z]+://', '')"
LINES = "SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line_no FROM documents"


def path_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query("scan_documents", "SELECT doc_id, source, lang, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def _(docs):
    return docs.select("doc_id", "source", "lang", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("filter_extension", "SELECT page_id, url FROM pages WHERE url LIKE '%.html' OR url LIKE '%.HTML'", "pages")
def _(pages):
    return pages.filter(F.endswith("url", F.lit(".html")) | F.endswith("url", F.lit(".HTML"))).select("page_id", "url")


@query("filter_path_prefix", f"SELECT page_id, {PATH} AS path FROM pages WHERE ({PATH}) LIKE 'm.%' AND contains({PATH}, '/en/')", "pages")
def _(pages):
    return path_of(pages).filter(F.startswith("path", F.lit("m.")) & F.contains("path", F.lit("/en/"))).select("page_id", "path")


@query("split_lines", f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_replace(raw, '\\r$', '') AS line FROM ({LINES})")
def _(docs):
    return R.split_lines(docs.filter("text IS NOT NULL"))


FRAG = "^[A-Z][a-z]* "


@query("fragment_lines", f"""
WITH l AS (SELECT doc_id, line_no, regexp_replace(raw, '\\r$', '') AS line FROM ({LINES})),
n AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{FRAG}') AND length(line) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS frag FROM l),
f AS (SELECT doc_id, frag, min(line_no) AS line_start, max(line_no) AS last, max(length(line)) AS longest, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS content FROM n GROUP BY doc_id, frag),
e AS (SELECT *, coalesce(lead(line_start) OVER (PARTITION BY doc_id ORDER BY frag), last) AS line_end FROM f)
SELECT doc_id, CAST(frag AS BIGINT) AS frag_no, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, content FROM e WHERE longest > 0""")
def _(docs):
    return R.fragments(docs.filter("text IS NOT NULL"), FRAG)


CLASS = "CASE " + " ".join(f"WHEN p LIKE '{n}/%' OR p LIKE '%/{n}/%' THEN '{c}'" for n, c in T.CATEGORIES) + " ELSE 'Unknown' END"
# Languages stand in for the knowledge directories.
FOLDERS = {"en": "BedrockWiki", "fr": "QuModDocs", "de": "接口", "es": "beta"}
FOLDED = "SELECT page_id, " + "".join("replace(" for _ in FOLDERS) + PATH + "".join(f", '/{k}/', '/{v}/')" for k, v in FOLDERS.items()) + " AS p FROM pages"


def folded(pages: DataFrame) -> DataFrame:
    p = F.regexp_replace("url", "^[a-z]+://", "")
    for k, v in FOLDERS.items():
        p = F.replace(p, F.lit(f"/{k}/"), F.lit(f"/{v}/"))
    return pages.select("page_id", p.alias("p"))


@query("classify_path", f"SELECT page_id, {CLASS} AS category FROM ({FOLDED})", "pages")
def _(pages):
    return folded(pages).select("page_id", T.classify_path(F.col("p")).alias("category"))


@query("route_category", f"SELECT * FROM (SELECT page_id, {CLASS} AS category FROM ({FOLDED})) WHERE category IN {T.INDEXED}", "pages")
def _(pages):
    return folded(pages).select("page_id", T.classify_path(F.col("p")).alias("category")).filter(F.col("category").isin(*T.INDEXED))


@query("count_by_category", f"SELECT coalesce(category, 'total') AS category, count(*) AS n FROM (SELECT {CLASS} AS category FROM ({FOLDED})) GROUP BY ROLLUP (category)", "pages")
def _(pages):
    return folded(pages).select(T.classify_path(F.col("p")).alias("category")).rollup("category").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("category", F.lit("total")).alias("category"), "n")


STOP = ["the", "of", "and", "de", "la", "der", "to", "in", "a", "le", "que", "die"]


@query("stopword_filter", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents) WHERE w NOT IN {tuple(STOP)} GROUP BY w")
def _(docs):
    words = docs.select(F.explode(T.tokenize_en(F.col("text"))).alias("word"))
    stop = docs.sparkSession.createDataFrame([(s,) for s in STOP], "word string")
    return words.join(F.broadcast(stop), "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("json_parse", "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events", "events")
def _(events):
    return events.select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("path_mapping", "SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'plain/' || substr(url, 8) WHEN url LIKE 'https://%' THEN 'secure/' || substr(url, 9) ELSE url END AS mapped FROM pages", "pages")
def _(pages):
    out = F.col("url")
    for old, new in (("http://", "plain/"), ("https://", "secure/")):
        out = F.when(F.startswith("url", F.lit(old)), F.concat(F.lit(new), F.substr("url", F.lit(len(old) + 1)))).otherwise(out)
    return pages.select("page_id", out.alias("mapped"))


@query("keep_extensions", f"SELECT page_id, {PATH} AS path, regexp_matches({PATH}, '\\.(html|json|lang)$') AS kept FROM pages", "pages")
def _(pages):
    return path_of(pages).select("page_id", "path", T.extension(F.col("path")).isin("html", "json", "lang").alias("kept"))


ENDINGS = {".html": "text/html", ".JSON": "application/json", ".png": "image/png", ".md": "text/markdown", ".css": "text/css", ".xyz": "application/octet-stream", "": None}


@query("mime_guess", f"SELECT page_id, CASE page_id % {len(ENDINGS)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(ENDINGS.values()) if m) + f" ELSE CASE WHEN regexp_matches({PATH}, '\\.html$') THEN 'text/html' ELSE 'application/octet-stream' END END AS mime FROM pages", "pages")
def _(pages):
    """Every page, with endings put behind its path in turn; every seventh page has its own."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return path_of(pages).select("page_id", T.media_type(F.concat("path", ending)).alias("mime"))


@query("list_dir", f"""SELECT DISTINCT CASE WHEN contains(rest, '/') THEN 'dir' ELSE 'file' END AS kind, split_part(rest, '/', 1) AS name
FROM (SELECT {PATH} AS rest FROM pages) WHERE split_part(rest, '/', 1) <> ''""", "pages")
def _(pages):
    return R.list_dir(path_of(pages), "")


@query("read_range", """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(l[2:4], chr(10)) AS content, CAST(len(l) AS BIGINT) AS total_lines FROM s""")
def _(docs):
    return R.read_range(docs.filter("text IS NOT NULL"), 2, 4)


@query("read_file", """SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM (SELECT doc_id, line_no, regexp_replace(raw, '\\r$', '') AS line FROM (%s)) GROUP BY doc_id""" % LINES)
def _(docs):
    lines = R.split_lines(docs.filter("text IS NOT NULL"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))


@query("pred_looks_english", "SELECT doc_id, regexp_matches(text, '[A-Za-z0-9_]') AND NOT regexp_matches(text, '[^\\x00-\\x7F]') AS english FROM documents")
def _(docs):
    return docs.select("doc_id", T.looks_english(F.col("text")).alias("english"))


WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents"


def words(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).alias("w")).distinct()


@query("pred_precise_identifier", f"SELECT w, length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 12 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') AS precise FROM ({WORDS})")
def _(docs):
    return words(docs).select("w", T.precise_identifier(F.col("w")).alias("precise"))


@query("pred_unsafe_path", "SELECT page_id, contains(url, '..') AS unsafe FROM pages", "pages")
def _(pages):
    return pages.select("page_id", T.unsafe_path(F.col("url")).alias("unsafe"))


@query("regex_match", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)th[aeiou]+nt')")
def _(docs):
    return docs.filter(T.regex_or_substring(F.col("text"), "th[aeiou]+nt")).select("doc_id")


@query("filter_name", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ar')", "part")
def _(part):
    return part.filter(F.contains("p_name", F.lit("ar"))).select("p_partkey", "p_name")


@query("snippet", "SELECT doc_id, CASE WHEN strlen(text) > 300 THEN left(text, 300) || '...' ELSE text END AS snippet FROM documents")
def _(docs):
    return docs.select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("truncate_value", "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS value FROM documents")
def _(docs):
    return docs.select("doc_id", T.truncate_value(F.col("text")).alias("value"))


@query("elide_lines", """WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 20 THEN array_to_string(list_concat(l[1:12], ['... (' || (len(l) - 18) || ' lines omitted) ...'], l[-6:]), chr(10)) ELSE text END AS shown FROM s""")
def _(docs):
    return docs.select("doc_id", T.elide_lines(F.col("text")).alias("shown"))


@query("paginate", "SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 5 AS BIGINT) AS page FROM documents QUALIFY page = 2")
def _(docs):
    # The rows of the first three pages are taken before they are numbered: no task numbers the whole table.
    some = docs.orderBy(F.desc("n_chars"), "doc_id").limit(15)
    return some.withColumn("page", F.floor((F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1) / 5)).filter("page = 2").select("doc_id", "page")


@query("tokenize_en", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def _(docs):
    t = T.tokenize_en(F.col("text"))
    return docs.select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query("normalize_tokens", f"""WITH t AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest({TOKENS}) AS w, generate_subscripts({TOKENS}, 1) AS i FROM documents) GROUP BY doc_id, w)
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM t GROUP BY doc_id""")
def _(docs):
    t = T.normalize_tokens(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)))
    return docs.select("doc_id", F.array_join(t, " ").alias("tokens")).filter("tokens <> ''")


@query("ascii_lower", f"SELECT doc_id, translate(text, '{T.UPPER}', '{T.LOWER}') AS lowered FROM documents")
def _(docs):
    return docs.select("doc_id", T.ascii_lower(F.col("text")).alias("lowered"))


@query("longest_identifier", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1) AS i FROM documents)
SELECT doc_id, arg_max(w, length(w) * 1000000 - i) AS ident FROM w WHERE regexp_matches(w, '^[A-Z]') AND contains(w, 'the') GROUP BY doc_id""")
def _(docs):
    return docs.select("doc_id", T.longest_identifier(F.col("text"), "the").alias("ident")).filter("ident IS NOT NULL")


@query("prefilter_split", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n，。]'), lambda x: x <> '')) AS BIGINT) AS n_parts FROM documents")
def _(docs):
    return docs.select("doc_id", F.size(F.filter(F.split("text", "[ \\t\\n，。]", -1), lambda x: x != "")).cast("long").alias("n_parts"))


@query("pos_tag", f"SELECT w, CASE WHEN NOT regexp_matches(w, '[\\x00-\\x7F]') THEN 'x' WHEN regexp_matches(w, '^[0-9]+$') THEN 'm' ELSE 'eng' END AS tag FROM ({WORDS})")
def _(docs):
    return words(docs).select("w", T.pos_rule(F.col("w")).alias("tag"))


@query("snake_case", f"SELECT p_partkey, translate(p_name, '{T.UPPER} -', '{T.LOWER}__') AS snake FROM part", "part")
def _(part):
    return part.select("p_partkey", T.snake_case(F.col("p_name")).alias("snake"))


@query("pascal_case", "SELECT p_partkey, array_to_string(list_transform(string_split(translate(p_name, '_-', '  '), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), '') AS pascal FROM part", "part")
def _(part):
    return part.select("p_partkey", T.pascal_case(F.col("p_name")).alias("pascal"))


@query("utf8_valid", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS runes, text IS NOT NULL AS valid FROM documents")
def _(docs):
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("runes"), F.coalesce(F.is_valid_utf8("text"), F.lit(False)).alias("valid"))


@query("fingerprint", "SELECT source, CAST(count(*) AS BIGINT) AS files, md5(string_agg(doc_id || ':' || n_chars, ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def _(docs):
    part = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("n_chars").cast("string"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda x: x["p"])
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.md5(F.array_join(listed, ",")).alias("fingerprint"))
