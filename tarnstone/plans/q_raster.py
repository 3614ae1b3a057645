"""Queries over pixel grids: each embedding is an 8 x 8 canvas, opaque where its value is positive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.operators import raster as R
from tarnstone.plans.base import query

RED, BLUE = (255, 0, 0, 255), (0, 0, 255, 255)
PALETTE = [(0, 0, 0, 255), (255, 255, 255, 255), (128, 64, 0, 255), (0, 0, 0, 0)]
E = ("embeddings",)


def pixels(embeddings: DataFrame) -> DataFrame:
    at = embeddings.select(F.col("vec_id").cast("long").alias("canvas"), F.posexplode("embedding").alias("i", "v"))
    level = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.round(F.col("v").cast("double") * k, 4) + 1) * 127).cast("int")))
    return at.select("canvas", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), level(1).alias("r"), level(2).alias("g"), level(-1).alias("b"), F.when(F.col("v") > 0, 255).otherwise(0).alias("a"))


LEVEL = "greatest(0, least(255, CAST(floor((round(CAST(v AS DOUBLE) * ({k}), 4) + 1) * 127) AS INTEGER)))"
P = f"""p AS (SELECT canvas, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, {LEVEL.format(k=1)} AS r, {LEVEL.format(k=2)} AS g, {LEVEL.format(k=-1)} AS b, CASE WHEN v > 0 THEN 255 ELSE 0 END AS a
FROM (SELECT CAST(vec_id AS BIGINT) AS canvas, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def painted(where: str, colour) -> str:
    return f"WITH {P} SELECT canvas, x, y, " + ", ".join(f"CASE WHEN {where} THEN {v} ELSE {c} END AS {c}" for c, v in zip("rgba", colour, strict=True)) + " FROM p"


@query("pixel_scan", f"WITH {P} SELECT * FROM p", *E)
def _(e):
    return pixels(e)


@query("canvas_new", """SELECT CAST(p_partkey AS BIGINT) AS canvas, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(p_size AS INTEGER) AS r, 0 AS g, 0 AS b, 255 AS a
FROM part, range(8) t(x), range(20) u(y) WHERE x < p_size % 8 AND y < 1 + p_size % 20""", "part")
def _(part):
    """A canvas for each part, as wide and tall as its size says; a width of 0 is no canvas."""
    size = F.col("p_size").cast("int")
    return R.new_canvases(part.select(F.col("p_partkey").cast("long").alias("canvas"), (size % 8).alias("width"), (1 + size % 20).alias("height"), size.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a")))


@query("draw_batch", painted("x = 2 AND y = 3", BLUE), *E)
def _(e):
    p = pixels(e)
    rows = [(0, 2, 3, *RED), (1, 2, 3, *BLUE), (2, 99, 3, *RED)]
    cmds = e.sparkSession.createDataFrame(rows, "seq int, x int, y int, r int, g int, b int, a int")
    return R.draw(p, p.select("canvas").distinct().join(F.broadcast(cmds.withColumn("k", F.lit(1))), F.lit(1) == F.col("k")).drop("k"))


@query("draw_line", painted("(x BETWEEN 0 AND 7 AND y = CAST(round(x * 3 / 7.0) AS INTEGER)) OR (y BETWEEN 0 AND 6 AND x = 6 - CAST(round(y * 2 / 6.0) AS INTEGER))", RED), *E)
def _(e):
    return R.draw_cells(R.draw_cells(pixels(e), R.line_cells(0, 0, 7, 3), RED), R.line_cells(4, 6, 6, 0), RED)


@query("draw_rect", painted("x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6 AND (x IN (1, 5) OR y IN (2, 6))", RED), *E)
def _(e):
    return R.rect(pixels(e), 1, 2, 5, 5, RED, filled=False)


@query("fill_rect", painted("x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6", RED), *E)
def _(e):
    return R.rect(pixels(e), 1, 2, 5, 5, RED)


@query("draw_circle", painted("(abs(x - 3) = 2 AND abs(y - 3) <= 1) OR (abs(y - 3) = 2 AND abs(x - 3) <= 1)", BLUE), *E)
def _(e):
    return R.draw_cells(pixels(e), R.circle_cells(3, 3, 2, False), BLUE)


@query("gradient", f"WITH {P} SELECT canvas, x, y, CAST(trunc(CAST(x AS FLOAT) / CAST(7 AS FLOAT) * 255) AS INTEGER) AS r, 0 AS g, 0 AS b, 255 AS a FROM p", *E)
def _(e):
    return R.gradient(pixels(e), 0, 0, 8, 8, (0, 0, 0, 255), RED)


NEAR = f"WITH {P}, s AS (SELECT * FROM p WHERE a > 0), n AS (SELECT DISTINCT canvas, x + dx AS x, y + dy AS y FROM s, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)) "


@query("outline", NEAR + "SELECT p.canvas, p.x, p.y, " + ", ".join(f"CASE WHEN p.a = 0 AND n.x IS NOT NULL THEN {v} ELSE p.{c} END AS {c}" for c, v in zip("rgba", RED, strict=True)) + " FROM p LEFT JOIN n USING (canvas, x, y)", *E)
def _(e):
    return R.outline(pixels(e), RED)


@query("shadow", f"WITH {P} SELECT p.canvas, p.x, p.y, " + ", ".join(f"CASE WHEN p.a = 0 AND coalesce(s.a, 0) > 0 THEN {v} ELSE p.{c} END AS {c}" for c, v in zip("rgba", (0, 0, 0, 127), strict=True)) + " FROM p LEFT JOIN p s ON s.canvas = p.canvas AND s.x + 1 = p.x AND s.y + 2 = p.y", *E)
def _(e):
    return R.shadow(pixels(e), 1, 2, (0, 0, 0, 255), 0.5)


@query("replace_color", painted("abs(r - 120) + abs(g - 120) + abs(b - 120) + abs(a - 255) <= 60", BLUE), *E)
def _(e):
    return R.replace_color(pixels(e), (120, 120, 120, 255), BLUE, 60)


DIST = "[" + ", ".join(f"{{'d': abs(r - {c[0]}) + abs(g - {c[1]}) + abs(b - {c[2]}) + abs(a - {c[3]}), 'i': {i}}}" for i, c in enumerate(PALETTE)) + "]"


@query("quantize", f"WITH {P}, q AS (SELECT canvas, x, y, list_min({DIST}).i AS i FROM p) SELECT canvas, x, y, " + ", ".join(f"CASE i " + " ".join(f"WHEN {i} THEN {col[k]}" for i, col in enumerate(PALETTE)) + f" END AS {c}" for k, c in enumerate("rgba")) + " FROM q", *E)
def _(e):
    return R.quantize(pixels(e), PALETTE)


@query("pixelate", f"WITH {P}, m AS (SELECT canvas, x // 3 AS bx, y // 3 AS by, " + ", ".join(f"CAST(floor(sum({c}) / count(*)) AS INTEGER) AS {c}" for c in "rgba") + " FROM p GROUP BY ALL) SELECT p.canvas, p.x, p.y, m.r, m.g, m.b, m.a FROM p JOIN m ON m.canvas = p.canvas AND m.bx = p.x // 3 AND m.by = p.y // 3", *E)
def _(e):
    return R.pixelate(pixels(e), 3)


@query("flip", f"WITH {P} SELECT canvas, 7 - x AS x, y, r, g, b, a FROM p", *E)
def _(e):
    return R.flip(pixels(e), True, 8, 8)


@query("rotate", f"WITH {P} SELECT canvas, 7 - y AS x, x AS y, r, g, b, a FROM p", *E)
def _(e):
    return R.rotate90(pixels(e), 5, 8, 8)


@query("crop", f"WITH {P} SELECT canvas, x - 2 AS x, y - 1 AS y, r, g, b, a FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3", *E)
def _(e):
    return R.crop(pixels(e), 2, 1, 4, 3)


@query("scale_nearest", f"WITH {P} SELECT canvas, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, r, g, b, a FROM p, range(5) t(i), range(11) u(j) WHERE i * 8 // 5 = x AND j * 8 // 11 = y", *E)
def _(e):
    return R.scale_nearest(pixels(e), 8, 8, 5, 11)


@query("preview_upscale", f"WITH {P} SELECT canvas, CAST(x * 2 + i AS INTEGER) AS x, CAST(y * 2 + j AS INTEGER) AS y, r, g, b, a FROM p, range(2) t(i), range(2) u(j)", *E)
def _(e):
    return R.upscale(pixels(e), 2)


HEX = "'#' || printf('%02X%02X%02X', r, g, b) || CASE WHEN a < 255 THEN printf('%02X', a) ELSE '' END"


@query("color_hex", f"WITH {P} SELECT canvas, x, y, {HEX} AS color FROM p", *E)
def _(e):
    return pixels(e).select("canvas", "x", "y", R.to_hex().alias("color"))


@query("read_area", f"WITH {P} SELECT canvas, y - 1 AS y, string_agg({HEX}, ' ' ORDER BY x) AS row FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3 GROUP BY canvas, y", *E)
def _(e):
    return R.read_area(pixels(e), 2, 1, 4, 3)


@query("color_count", f"WITH {P} SELECT canvas, count(DISTINCT (r, g, b, a)) AS colors FROM p GROUP BY canvas", *E)
def _(e):
    return R.color_count(pixels(e))


@query("canvas_info", f"WITH {P} SELECT canvas, CAST(max(x) + 1 AS BIGINT) AS width, CAST(max(y) + 1 AS BIGINT) AS height, count(*) AS pixels, count(DISTINCT (r, g, b, a)) AS colors FROM p GROUP BY canvas", *E)
def _(e):
    return R.canvas_info(pixels(e))


@query("canvas_idle", "SELECT user_id AS canvas, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE", "events")
def _(events):
    return R.idle_canvases(events.select(F.col("user_id").alias("canvas"), "ts"), events.agg(F.max("ts")).scalar())


BLEND = "(sa + da * (1 - sa))"


@query("alpha_blend", f"""WITH {P}, v AS (SELECT canvas, x, y, r, g, b, (x * 37 + y * 11) % 256 AS a FROM p), u AS (SELECT canvas, 7 - x AS x, y, r AS ur, g AS ug, b AS ub, a AS ua FROM v),
m AS (SELECT *, a / 255.0::DOUBLE AS sa, ua / 255.0::DOUBLE AS da FROM v JOIN u USING (canvas, x, y))
SELECT canvas, x, y, """ + ", ".join(f"CAST(CASE WHEN {BLEND} = 0 THEN 0 ELSE floor(({c} * sa + u{c} * da * (1 - sa)) / {BLEND} + 1e-9) END AS INTEGER) AS {c}" for c in "rgb") + f", CAST(floor({BLEND} * 255 + 1e-9) AS INTEGER) AS a FROM m", *E)
def _(e):
    p = pixels(e).withColumn("a", ((F.col("x") * 37 + F.col("y") * 11) % 256).cast("int"))
    return R.alpha_blend(p, R.flip(p, True, 8, 8))


@query("flood_fill", f"""WITH RECURSIVE {P}, l AS (SELECT p.canvas, p.x, p.y FROM p JOIN p s ON s.canvas = p.canvas AND s.x = 3 AND s.y = 3 WHERE abs(p.r - s.r) + abs(p.g - s.g) + abs(p.b - s.b) + abs(p.a - s.a) <= 300),
f(canvas, x, y) AS (SELECT canvas, x, y FROM l WHERE x = 3 AND y = 3 UNION SELECT l.canvas, l.x, l.y FROM f JOIN l ON l.canvas = f.canvas AND abs(l.x - f.x) + abs(l.y - f.y) = 1)
SELECT p.canvas, p.x, p.y, """ + ", ".join(f"CASE WHEN f.x IS NOT NULL THEN {v} ELSE p.{c} END AS {c}" for c, v in zip("rgba", RED, strict=True)) + " FROM p LEFT JOIN f USING (canvas, x, y)", *E)
def _(e):
    return R.flood_fill(pixels(e), 3, 3, RED, 300)


STEP = "[" + ", ".join(f"{{'d': pow(r[i] - {c[0]}, 2) + pow(g[i] - {c[1]}, 2) + pow(b[i] - {c[2]}, 2) + pow(a[i] - {c[3]}, 2), 'k': {k}}}" for k, c in enumerate(PALETTE)) + "]"


def _diffused(c: str, k: int) -> str:
    to = "[" + ", ".join(f"{p[k]}e0" for p in PALETTE) + "][pick + 1]"
    share = lambda part: f"greatest(0e0, least(255e0, v + (o{c} - {to}) * {part} / 16))"
    return f"""list_transform({c}, lambda v, j: CASE WHEN j = i THEN {to} WHEN j = i + 1 AND i % 8 <> 0 THEN {share(7)} WHEN j = i + 7 AND i % 8 <> 1 THEN {share(3)}
WHEN j = i + 8 THEN {share(5)} WHEN j = i + 9 AND i % 8 <> 0 THEN {share(1)} ELSE v END) AS {c}"""


@query("dither", f"""WITH RECURSIVE {P}, s AS (SELECT canvas, 1 AS i, {', '.join(f'list(CAST({c} AS DOUBLE) ORDER BY y, x) AS {c}' for c in 'rgba')} FROM p GROUP BY canvas),
f AS (SELECT * FROM s UNION ALL SELECT canvas, i + 1 AS i, {', '.join(_diffused(c, k) for k, c in enumerate('rgb'))}, list_transform(a, lambda v, j: CASE WHEN j = i THEN [{', '.join(f'{p[3]}e0' for p in PALETTE)}][pick + 1] ELSE v END) AS a
FROM (SELECT *, r[i] AS "or", g[i] AS og, b[i] AS ob, list_min({STEP}).k AS pick FROM f WHERE i <= 64))
SELECT canvas, CAST((j - 1) % 8 AS INTEGER) AS x, CAST((j - 1) // 8 AS INTEGER) AS y, {', '.join(f'CAST({c}[j] AS INTEGER) AS {c}' for c in 'rgba')} FROM f, (SELECT unnest(range(1, 65)) AS j) WHERE i = 65""".replace("(or -", '("or" -'), *E)
def _(e):
    return R.dither(pixels(e), PALETTE)


def _halved(level: int) -> str:
    box = "PARTITION BY canvas, box"
    span = {c: f"max({c}) OVER ({box}) - min({c}) OVER ({box})" for c in "rgb"}
    return f"""m{level} AS (SELECT *, count(*) OVER ({box}) AS n, CASE WHEN {span['r']} >= {span['g']} AND {span['r']} >= {span['b']} THEN r WHEN {span['g']} >= {span['b']} THEN g ELSE b END AS v FROM l{level}),
l{level + 1} AS (SELECT canvas, r, g, b, a, 2 * box + CASE WHEN n > 1 AND k > n // 2 THEN 1 ELSE 0 END AS box, k AS pos FROM (SELECT *, row_number() OVER ({box} ORDER BY v, pos) AS k FROM m{level}))"""


@query("median_cut", f"""WITH {P}, l0 AS (SELECT canvas, r, g, b, a, 0 AS box, y * 8 + x AS pos FROM p WHERE a > 0), {_halved(0)}, {_halved(1)}
SELECT canvas, row_number() OVER (PARTITION BY canvas ORDER BY box) - 1 AS at, {', '.join(f'CAST(floor(sum({c}) / count(*)) AS INTEGER) AS {c}' for c in 'rgba')} FROM l2 GROUP BY canvas, box""", *E)
def _(e):
    return R.extract_palette(pixels(e), 4)


COMMANDS = """c AS (SELECT CAST(p_partkey % 500 AS BIGINT) AS canvas, p_partkey AS seq, p_size % 9 - 1 AS cx, (p_partkey // 8) % 9 - 1 AS cy, 1 + p_size % 5 AS w, 1 + p_partkey % 4 AS h, p_size % 2 = 0 AS filled,
CAST(p_partkey % 256 AS INTEGER) AS nr, CAST(p_size AS INTEGER) AS ng, CAST((p_partkey * 7) % 256 AS INTEGER) AS nb, 255 AS na FROM part)"""


@query("draw_rects", f"""WITH {P}, {COMMANDS}, h AS (SELECT p.canvas, x, y, arg_max({{'r': nr, 'g': ng, 'b': nb, 'a': na}}, seq) AS c FROM p JOIN c ON c.canvas = p.canvas AND x BETWEEN cx AND cx + w - 1 AND y BETWEEN cy AND cy + h - 1
WHERE filled OR x IN (cx, cx + w - 1) OR y IN (cy, cy + h - 1) GROUP BY p.canvas, x, y)
SELECT p.canvas, p.x, p.y, {', '.join(f'coalesce(h.c.{c}, p.{c}) AS {c}' for c in 'rgba')} FROM p LEFT JOIN h USING (canvas, x, y)""", "embeddings", "part")
def _(e, part):
    """A rectangle for each part, drawn on the canvas that its key names."""
    key, size = F.col("p_partkey"), F.col("p_size")
    colour = [(key % 256).cast("int").alias("r"), size.cast("int").alias("g"), ((key * 7) % 256).cast("int").alias("b"), F.lit(255).alias("a")]
    place = [(size % 9 - 1).cast("int").alias("x"), (F.floor(key / 8) % 9 - 1).cast("int").alias("y"), (1 + size % 5).cast("int").alias("w"), (1 + key % 4).cast("int").alias("h")]
    return R.rects(pixels(e), part.select((key % 500).cast("long").alias("canvas"), key.alias("seq"), *place, (size % 2 == 0).alias("filled"), *colour), tile=4)


@query("png_preview", None, *E)
def _(e):
    return R.to_png(pixels(e)).select("canvas", F.base64("png").alias("png"))
