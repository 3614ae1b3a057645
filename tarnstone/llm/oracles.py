"""DuckDB statements for those operators whose results SQL can express on whole tables."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]+"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{WS}'), lambda x: x <> '')"


WINDOWS = f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(list_slice(w, i, i + 19), ' '))) AS k, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
g AS (SELECT u.doc_id, word, j, max(rep.i) OVER (PARTITION BY u.doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM u LEFT JOIN rep ON rep.doc_id = u.doc_id AND rep.i = j),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(f"translate(text, '{UP}', '{LOW}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
t AS (SELECT doc_id, no, line, doc_id * 10000000 + no AS pos, list_sort(list_distinct({words('line')})) AS s FROM l),
sets AS (SELECT s, min(pos) AS first, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s),
e AS (SELECT first, n, unnest(s) AS w FROM sets),
df AS (SELECT w, count(*) AS df FROM e GROUP BY w),
pre AS (SELECT first, n, w FROM (SELECT first, n, w, row_number() OVER (PARTITION BY first ORDER BY df, w) AS r FROM e JOIN df USING (w)) WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.first AS x, b.first AS y FROM pre a JOIN pre b ON a.w = b.w AND a.first < b.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
near AS (SELECT DISTINCT y FROM (SELECT y, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS c FROM cand JOIN sets a ON a.first = x JOIN sets b ON b.first = y) WHERE 100 * c >= 80 * (total - c)),
g AS (SELECT t.doc_id, t.no, t.line, sets.first IS NOT NULL AND (t.pos <> sets.first OR near.y IS NOT NULL) AS gone FROM t LEFT JOIN sets USING (s) LEFT JOIN near ON near.y = sets.first),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END AS n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k JOIN documents USING (doc_id)"""

LEAKS = f"""
WITH d AS (SELECT doc_id, {words(f"translate(text, '{UP}', '{LOW}')")} AS w FROM documents),
b AS (SELECT item_id, {words(f"translate(text, '{UP}', '{LOW}')")} AS v FROM benchmark),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS k, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4),
bg AS (SELECT item_id, unnest(list_transform(range(1, len(v) - 2), lambda i: array_to_string(list_slice(v, i, i + 3), ' '))) AS k, unnest(range(1, len(v) - 2)) AS a FROM b WHERE len(v) >= 5),
al AS (SELECT DISTINCT doc_id, item_id, p - a AS s FROM dg JOIN bg USING (k)),
win AS (SELECT doc_id, item_id, s, w, v, least(13, len(v)) AS m, unnest(range(1, len(v) - least(13, len(v)) + 2)) AS a FROM al JOIN d USING (doc_id) JOIN b USING (item_id)),
hit AS (SELECT doc_id, item_id, len(v) AS n, m, a, a + s - 1 AS p FROM win WHERE a + s >= 1 AND a + s + m - 1 <= len(w)
  AND list_sum(list_transform(range(0, m), lambda k: CASE WHEN v[a + k] = w[a + s + k] THEN 1 ELSE 0 END)) >= m - CASE WHEN m = 13 THEN 2 ELSE 0 END),
o AS (SELECT doc_id, item_id, n, count(DISTINCT a) AS n_windows, min(p) AS first_word FROM hit GROUP BY ALL),
c AS (SELECT doc_id, item_id, count(DISTINCT j) AS n_matched FROM (SELECT doc_id, item_id, unnest(range(a, a + m)) AS j FROM hit) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_words, n_windows, n_matched, CAST(first_word AS BIGINT) AS first_word FROM o JOIN c USING (doc_id, item_id)"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [
        "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, k, list_slice(v, k * (len(v) // {parts}) + 1, (k + 1) * (len(v) // {parts})) AS x FROM e, (SELECT unnest(range({parts})) AS k))",
        f"b0 AS MATERIALIZED (SELECT k, j, x FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j FROM p) WHERE j < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, k, m // {entries} AS error, m % {entries} AS j FROM (SELECT vec_id, k, min(CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {entries} + j) AS m FROM p JOIN b{r} b USING (k) GROUP BY ALL))")
        if r < rounds:
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT k, j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT k, j, list(y ORDER BY i) AS x FROM (SELECT k, j, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT k, j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{r} USING (vec_id, k)) GROUP BY ALL) GROUP BY ALL) m USING (k, j))")
    steps.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY k) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN e USING (vec_id), s"


CODES = _vector_codes()

MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({words('text')}) AS BIGINT) AS size, CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT *, CAST([3, 1, 2][number % 3 + 1] AS DOUBLE) AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source)),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5e0 AS budget, CAST(least(128, greatest(1, sum(source_size) // 16384)) AS BIGINT) AS b FROM s),
l(step, lam) AS (SELECT 0, budget / sum(weight) FROM s, t GROUP BY budget UNION ALL
  SELECT step + 1, (budget - coalesce(sum(2e0 * source_size) FILTER (weight * lam > 2e0 * source_size), 0)) / sum(weight) FILTER (weight * lam <= 2e0 * source_size) FROM l, s, t WHERE step < 40 GROUP BY step, lam, budget),
g AS (SELECT source, source_size, number, least(weight * lam, 2e0 * source_size) AS target, CAST(greatest(1, ceil(sqrt(source_size / 1024e0))) AS BIGINT) AS n_shards FROM s, (SELECT lam FROM l ORDER BY step DESC LIMIT 1)),
p AS (SELECT doc_id, size, key, number, source_size, target, key % n_shards AS shard FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
h AS (SELECT number, shard, CAST(ceil(sum(size) / CAST(b AS DOUBLE)) AS BIGINT) AS blocks FROM p, t GROUP BY number, shard, b),
v AS (SELECT number, CAST(sum(blocks) AS BIGINT) AS n, target >= 2e0 * source_size AS capped, CASE WHEN source_size > 0 THEN target * CAST(sum(blocks) AS DOUBLE) / source_size ELSE 0e0 END AS votes FROM h JOIN g USING (number) GROUP BY number, target, source_size),
sq AS (SELECT number, votes / (2e0 * q - 1) AS quotient FROM (SELECT number, votes, unnest(range(1, 2 * n + 1)) AS q FROM v WHERE NOT capped)),
won AS (SELECT number, count(*) AS quota FROM (SELECT number, row_number() OVER (ORDER BY quotient DESC, number) AS r FROM sq) WHERE r <= (SELECT round_even(sum(votes), 0) FROM v WHERE NOT capped) GROUP BY number),
quota AS (SELECT number, CASE WHEN capped THEN 2 * n ELSE coalesce(quota, 0) END AS quota FROM v LEFT JOIN won USING (number)),
hq AS (SELECT number, shard, blocks / (2e0 * q - 1) AS quotient FROM (SELECT number, shard, blocks, unnest(range(1, 2 * blocks + 1)) AS q FROM h)),
hw AS (SELECT number, shard, count(*) AS quota FROM (SELECT number, shard, row_number() OVER (PARTITION BY number ORDER BY quotient DESC, shard) AS r FROM hq) JOIN quota USING (number) WHERE r <= quota GROUP BY number, shard),
z AS (SELECT number, shard, blocks, coalesce(quota, 0) AS quota, CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('11:' || number || ':' || shard), 1, 15) AS BIGINT) % blocks ELSE 0 END AS start FROM h LEFT JOIN hw USING (number, shard)),
a AS (SELECT doc_id, key, size, source_size, target, blocks, quota, start, b, CAST(sum(size) OVER (PARTITION BY number, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS pos, row_number() OVER () AS id FROM p JOIN z USING (number, shard), t),
j AS (SELECT *, unnest(range(pos // b, (pos + size - 1) // b + 1)) AS j FROM a WHERE size > 0),
k AS (SELECT id, sum((least(pos + size, (j + 1) * b) - greatest(pos, j * b)) * (quota // blocks + ((j + 1 + start) * (quota % blocks)) // blocks - ((j + start) * (quota % blocks)) // blocks)) AS taken FROM j GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM a LEFT JOIN k USING (id)"""

ORACLE_SQL = {"op1_line_dedup": LINES, "op4_ngram_join": NEAR, "op6_decontaminate": LEAKS, "op8_window_dedup": WINDOWS, "op11_source_mix": MIX, "op12_vector_codes": CODES}
