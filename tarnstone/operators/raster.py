"""Pixel grids as tables: canvas, x, y, r, g, b, a (0..255). Every operator works on all canvases at once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGBA = ("r", "g", "b", "a")
XY = ("canvas", "x", "y")
#: Widest and tallest canvas.
MOST = 4096
#: Places of the canvases that are settled together; a larger canvas is settled alone.
STACK = 1 << 17
#: Side of the tiles in which rectangles and pixels meet.
TILE = 32


def from_hex(text: str) -> tuple[int, int, int, int]:
    digits = text.lstrip("#")
    if len(digits) not in (6, 8):
        raise ValueError(f"not a colour: {text!r}")
    return tuple(int((digits + "ff")[i : i + 2], 16) for i in (0, 2, 4, 6))


def to_hex() -> Column:
    pair = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    return F.concat(F.lit("#"), *[pair(c) for c in "rgb"], F.when(F.col("a") < 255, pair("a")).otherwise(F.lit("")))


def distance(colour: tuple[int, int, int, int]) -> Column:
    return sum((F.abs(F.col(c) - v) for c, v in zip(RGBA[1:], colour[1:], strict=True)), F.abs(F.col("r") - colour[0]))


def paint(pixels: DataFrame, where: Column, colour: tuple[int, int, int, int]) -> DataFrame:
    return pixels.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in zip(RGBA, colour, strict=True)})


def new_canvas(spark, width: int, height: int, colour: tuple[int, int, int, int] = (0, 0, 0, 0), canvas: int = 0) -> DataFrame:
    if not (1 <= width <= MOST and 1 <= height <= MOST):
        raise ValueError("a canvas is 1 to 4096 pixels wide and tall")
    rows = spark.range(height).select(F.lit(canvas).cast("long").alias("canvas"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), F.col("id").cast("int").alias("y"))
    return rows.select("*", *[F.lit(v).alias(c) for c, v in zip(RGBA, colour, strict=True)])


def new_canvases(wanted: DataFrame) -> DataFrame:
    """The canvases that a table asks for (canvas, width, height, r, g, b, a); those without area or beyond the bounds are left out."""
    right = F.col("width").between(1, MOST) & F.col("height").between(1, MOST)
    rows = wanted.filter(right).select("canvas", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width", *RGBA)
    return rows.select("canvas", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y", *RGBA)


def draw(pixels: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: canvas, seq, x, y, r, g, b, a. The last of each place wins; places off the canvas are ignored."""
    last = commands.groupBy(*XY).agg(F.max_by(F.struct(*RGBA), "seq").alias("new"))
    return pixels.join(last, list(XY), "left").select(*XY, *[F.coalesce(F.col("new")[c], F.col(c)).alias(c) for c in RGBA])


def line_cells(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """The cells of a line by integer error steps."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    err, out = dx + dy, []
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        twice = 2 * err
        if twice >= dy:
            err, x0 = err + dy, x0 + sx
        if twice <= dx:
            err, y0 = err + dx, y0 + sy


def circle_cells(cx: int, cy: int, r: int, filled: bool) -> set[tuple[int, int]]:
    """The midpoint circle, or its spans."""
    x, y, err, out = r, 0, 1 - r, set()
    while x >= y:
        for a, b in ((x, y), (y, x)):
            for s in (b, -b):
                out.update((cx + i, cy + s) for i in (range(-a, a + 1) if filled else (-a, a)))
        y += 1
        if err < 0:
            err += 2 * y + 1
        else:
            x -= 1
            err += 2 * (y - x) + 1
    return out


def draw_cells(pixels: DataFrame, cells, colour: tuple[int, int, int, int]) -> DataFrame:
    """The cells painted on every canvas; the list is bounded by a canvas and broadcast."""
    marked = pixels.sparkSession.createDataFrame(sorted(set(cells)), "x int, y int").withColumn("hit", F.lit(True))
    out = pixels.join(F.broadcast(marked), ["x", "y"], "left")
    return paint(out, F.col("hit"), colour).select(*XY, *RGBA)


def rect(pixels: DataFrame, x: int, y: int, w: int, h: int, colour, filled: bool = True) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    edge = F.col("x").isin(x, x + w - 1) | F.col("y").isin(y, y + h - 1)
    return paint(pixels, inside if filled else inside & edge, colour)


def rects(pixels: DataFrame, commands: DataFrame, tile: int = TILE) -> DataFrame:
    """Rectangles painted on canvases; the last that covers a place wins.

    commands: canvas, seq (all different on a canvas), x, y, w, h, filled, r, g, b, a. An outline is four thin rectangles.
    Rectangles and pixels meet in square tiles of the canvas; of those that leave the same box in a tile, the last hides the
    others, and of those that cover a whole tile, the last hides all before it. Rectangles without area, or off the canvas,
    paint nothing; a null in filled counts as filled.
    """
    side = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    x, y, w, h, one = F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1)
    edges = F.array(side(x, y, w, one), side(x, y + h - 1, w, one), side(x, y, one, h), side(x + w - 1, y, one, h))
    sized = pixels.groupBy("canvas").agg(F.max("x").alias("right"), F.max("y").alias("low"))
    # Both joins are merges by hint: a plan takes exploded rows for as few as the file they come from, and would broadcast them.
    on = commands.filter((w > 0) & (h > 0)).select("canvas", "seq", "x", "y", "w", "h", "filled", F.struct(*RGBA).alias("new")).hint("merge").join(sized, "canvas")
    boxes = on.select("canvas", "seq", "new", "right", "low", F.explode(F.when(F.coalesce("filled", F.lit(True)), F.array(side(x, y, w, h))).otherwise(edges)).alias("box")).select("canvas", "seq", "new", "right", "low", "box.*")
    inside = boxes.select(
        "canvas", "seq", "new", F.greatest(x, F.lit(0)).alias("x0"), F.least(x + w - 1, "right").alias("x1"), F.greatest(y, F.lit(0)).alias("y0"), F.least(y + h - 1, "low").alias("y1")
    ).filter("x0 <= x1 AND y0 <= y1")
    tiles = inside.withColumn("tx", F.explode(F.expr(f"sequence(x0 div {tile}, x1 div {tile})"))).withColumn("ty", F.explode(F.expr(f"sequence(y0 div {tile}, y1 div {tile})")))
    left, top = F.col("tx") * tile, F.col("ty") * tile
    cut = {"x0": F.greatest("x0", left), "x1": F.least("x1", left + tile - 1), "y0": F.greatest("y0", top), "y1": F.least("y1", top + tile - 1)}
    last = tiles.withColumns(cut).groupBy("canvas", "tx", "ty", *cut).agg(F.max("seq").alias("seq"), F.max_by("new", "seq").alias("new"))
    whole = (F.col("x1") - F.col("x0") == tile - 1) & (F.col("y1") - F.col("y0") == tile - 1)
    hides = F.max(F.when(whole, F.col("seq"))).over(Window.partitionBy("canvas", "tx", "ty"))
    seen = last.withColumn("hides", hides).filter("hides IS NULL OR seq >= hides").drop("hides").hint("merge")
    at = pixels.select(*XY, *RGBA).withColumns({"tx": F.expr(f"x div {tile}"), "ty": F.expr(f"y div {tile}")})
    hit = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    painted = at.join(seen, ["canvas", "tx", "ty"]).filter(hit).groupBy(*XY).agg(F.max_by("new", "seq").alias("new"))
    return pixels.join(painted, list(XY), "left").select(*XY, *[F.coalesce(F.col("new")[c], F.col(c)).alias(c) for c in RGBA])


def gradient(pixels: DataFrame, x: int, y: int, w: int, h: int, first, last, horizontal: bool = True) -> DataFrame:
    at, n = (F.col("x") - x, w) if horizontal else (F.col("y") - y, h)
    t = (at.cast("float") / F.lit(float(max(1, n - 1))).cast("float")).cast("float")
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    mixed = lambda a, b: (F.lit(a).cast("float") + F.lit(b - a).cast("float") * t).cast("int")
    return pixels.withColumns({c: F.when(inside, mixed(a, b)).otherwise(F.col(c)) for c, a, b in zip(RGBA, first, last, strict=True)})


def _shifted(pixels: DataFrame, dx: int, dy: int) -> DataFrame:
    return pixels.select("canvas", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


def outline(pixels: DataFrame, colour, thickness: int = 1) -> DataFrame:
    """Transparent pixels beside an opaque one take the colour, thickness times."""
    for _ in range(thickness):
        solid = pixels.filter("a > 0")
        near = None
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            one = _shifted(solid, dx, dy)
            near = one if near is None else near.unionByName(one)
        out = pixels.join(near.distinct().withColumn("near", F.lit(True)), list(XY), "left")
        pixels = paint(out, (F.col("a") == 0) & F.coalesce("near", F.lit(False)), colour).select(*XY, *RGBA)
    return pixels


def shadow(pixels: DataFrame, dx: int, dy: int, colour, opacity: float = 0.6) -> DataFrame:
    cast = _shifted(pixels.filter("a > 0"), dx, dy).distinct().withColumn("shade", F.lit(True))
    out = pixels.join(cast, list(XY), "left")
    return paint(out, (F.col("a") == 0) & F.coalesce("shade", F.lit(False)), (*colour[:3], int(np.float32(opacity) * 255))).select(*XY, *RGBA)


def replace_color(pixels: DataFrame, old, new, tolerance: int = 0) -> DataFrame:
    return paint(pixels.withColumn("d", distance(old)), F.col("d") <= tolerance, new).select(*XY, *RGBA)


def quantize(pixels: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """The nearest palette colour by Manhattan distance, the first among equals. The palette is a constant of the plan."""
    best = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip(RGBA, c, strict=True)]) for i, c in enumerate(palette)]))
    return pixels.withColumn("best", best).select(*XY, *[F.col("best")[c].alias(c) for c in RGBA])


def pixelate(pixels: DataFrame, factor: int) -> DataFrame:
    """Each block takes its mean, cut to whole numbers; blocks at the edge may be smaller."""
    block = [F.floor(F.col("x") / factor).alias("bx"), F.floor(F.col("y") / factor).alias("by")]
    mean = pixels.groupBy("canvas", *block).agg(*[F.floor(F.sum(c) / F.count(F.lit(1))).cast("int").alias(c) for c in RGBA])
    return pixels.select(*XY, *block).join(mean, ["canvas", "bx", "by"]).select(*XY, *RGBA)


def flip(pixels: DataFrame, horizontal: bool, width: int, height: int) -> DataFrame:
    return pixels.withColumn("x", width - 1 - F.col("x")) if horizontal else pixels.withColumn("y", height - 1 - F.col("y"))


def rotate90(pixels: DataFrame, times: int, width: int, height: int) -> DataFrame:
    """Clockwise quarter turns."""
    for _ in range(times % 4):
        pixels = pixels.select("canvas", (F.lit(height - 1) - F.col("y")).alias("x"), F.col("x").alias("y"), *RGBA)
        width, height = height, width
    return pixels


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.filter(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def scale_nearest(pixels: DataFrame, width: int, height: int, new_w: int, new_h: int) -> DataFrame:
    """Each source pixel gives the target cells that map onto it: a projection without a join."""
    xs = F.filter(F.sequence(F.lit(0), F.lit(new_w - 1)), lambda i: F.floor(i * width / new_w) == F.col("x"))
    ys = F.filter(F.sequence(F.lit(0), F.lit(new_h - 1)), lambda i: F.floor(i * height / new_h) == F.col("y"))
    return pixels.select("canvas", F.explode(xs).alias("nx"), "y", *RGBA).select("canvas", F.col("nx").alias("x"), F.explode(ys).alias("ny"), *RGBA).select("canvas", "x", F.col("ny").alias("y"), *RGBA)


def upscale(pixels: DataFrame, factor: int) -> DataFrame:
    factor = max(1, min(16, factor))
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = pixels.select("canvas", F.explode(step).alias("i"), "x", "y", *RGBA).select("canvas", (F.col("x") * factor + F.col("i")).alias("x"), F.explode(step).alias("j"), "y", *RGBA)
    return wide.select("canvas", "x", (F.col("y") * factor + F.col("j")).alias("y"), *RGBA)


def read_area(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """canvas, y, row: colours of each row of an area, joined by a space."""
    some = crop(pixels, x, y, w, h).select("canvas", "x", "y", to_hex().alias("c"))
    return some.groupBy("canvas", "y").agg(F.array_join(F.sort_array(F.collect_list(F.struct("x", "c")))["c"], " ").alias("row"))


def color_count(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("canvas").agg(F.countDistinct(*RGBA).alias("colors"))


def canvas_info(pixels: DataFrame) -> DataFrame:
    """canvas, width, height, pixels, colors."""
    size = [(F.max(c) + 1).cast("long").alias(n) for c, n in (("x", "width"), ("y", "height"))]
    return pixels.groupBy("canvas").agg(*size, F.count(F.lit(1)).alias("pixels"), F.countDistinct(*RGBA).alias("colors"))


def idle_canvases(used: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """canvas, last: canvases whose last use (canvas, ts) lies further back, which their owner may have left open."""
    return used.groupBy("canvas").agg(F.max("ts").alias("last")).filter(F.col("last") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def alpha_blend(top: DataFrame, under: DataFrame) -> DataFrame:
    """top over under, straight alpha."""
    f = lambda c: F.col(c).cast("double")
    both = top.join(under.select(*XY, *[F.col(c).alias(f"u{c}") for c in RGBA]), list(XY))
    sa, da = f("a") / 255, f("ua") / 255
    oa = sa + da * (1 - sa)
    mixed = lambda c: F.when(oa == 0, 0).otherwise(F.floor((f(c) * sa + f(f"u{c}") * da * (1 - sa)) / oa + 1e-9))
    return both.select(*XY, *[mixed(c).cast("int").alias(c) for c in "rgb"], F.floor(oa * 255 + 1e-9).cast("int").alias("a"))


# ---------------------------------------------------------------- whole canvases, one at a time

def _grids(pdf: pd.DataFrame) -> np.ndarray:
    grid = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, 4), np.int64)
    grid[pdf["y"], pdf["x"]] = pdf[list(RGBA)].to_numpy()
    return grid


def _frame(canvas, grid: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(grid.shape[:2])
    out = pd.DataFrame({"canvas": canvas, "x": x.ravel(), "y": y.ravel()})
    for i, c in enumerate(RGBA):
        out[c] = grid[:, :, i].ravel()
    return out


def _settled(rows: pa.Table, settle: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Rows of whole canvases, with the colours that settle gives their places: a sparse canvas gains none."""
    batch = rows.combine_chunks().to_batches()[0]
    canvas = batch["canvas"].dictionary_encode(null_encoding="encode").indices.to_numpy()
    x, y = batch["x"].to_numpy(), batch["y"].to_numpy()
    colours = np.stack([batch[c].to_numpy() for c in RGBA], axis=1).astype(np.int64)
    size = np.zeros((canvas.max() + 1, 2), np.int64)
    np.maximum.at(size, canvas, np.stack([y, x], axis=1) + 1)
    shapes, shape = np.unique(size, axis=0, return_inverse=True)
    shape, place = shape.ravel(), np.empty(len(size), np.int64)
    for k, (h, w) in enumerate(shapes):
        alike, most = np.flatnonzero(shape == k), max(1, STACK // (h * w))
        for some in (alike[i : i + most] for i in range(0, len(alike), most)):
            place[:] = -1
            place[some] = np.arange(len(some))
            mine = np.flatnonzero(place[canvas] >= 0)
            at = (place[canvas[mine]], y[mine], x[mine])
            grid, there = np.zeros((len(some), h, w, 4), np.int64), np.zeros((len(some), h, w), bool)
            grid[at], there[at] = colours[mine], True
            colours[mine] = settle(grid, there)[at]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(colours[:, i].astype(np.int32)) for i in range(4)]], [*XY, *RGBA])


def _whole(pixels: DataFrame, settle: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """settle (grids of one shape, which places are there -> grids) on all canvases, many at a time. A task holds the canvases of
    one Arrow batch, or one canvas that is larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            canvas = pa.concat_arrays([*(k["canvas"].slice(len(k) - 1) for k in kept[-1:]), batch["canvas"]]).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.flatnonzero(canvas[1:] != canvas[:-1]) + (0 if kept else 1)
            if len(new):
                done = [*kept, batch.slice(0, new[-1])]
                yield _settled(pa.Table.from_batches(done), settle)
                kept = []
            kept.append(batch.slice(new[-1] if len(new) else 0))
        if kept:
            yield _settled(pa.Table.from_batches(kept), settle)

    return pixels.select(*XY, *[F.col(c).cast("int") for c in RGBA]).repartition("canvas").sortWithinPartitions("canvas").mapInArrow(run, SCHEMA)


SCHEMA = "canvas long, x int, y int, r int, g int, b int, a int"


def flood_fill(pixels: DataFrame, x: int, y: int, colour, tolerance: int = 0) -> DataFrame:
    """The connected area about a place whose colours lie within the tolerance of it. A canvas is at most 4096 x 4096."""

    def filled(grid: np.ndarray, there: np.ndarray) -> np.ndarray:
        if not (0 <= y < grid.shape[1] and 0 <= x < grid.shape[2]):
            return grid
        first = grid[:, y, x]
        like = there & (np.abs(grid - first[:, None, None]).sum(axis=3) <= tolerance)
        front = np.zeros(like.shape, bool)
        front[:, y, x] = there[:, y, x] & (first != np.array(colour)).any(axis=1)
        area = front.copy()
        while front.any():
            near = np.zeros_like(front)
            near[:, 1:] |= front[:, :-1]
            near[:, :-1] |= front[:, 1:]
            near[:, :, 1:] |= front[:, :, :-1]
            near[:, :, :-1] |= front[:, :, 1:]
            front = near & like & ~area
            area |= front
        grid[area] = colour
        return grid

    return _whole(pixels, filled)


def dithered(grid: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Error diffusion over one grid, or over each of a stack. A cell hangs on its left neighbour and three cells of the row above, so all cells with the
    same x + 2 y are settled in one step.

    Shares are clipped as they come: a cell gets 1/16 and 5/16 in earlier steps, then 3/16 from its upper right and 7/16 from
    its left in this order, as row by row.
    """
    shape, grid = grid.shape, grid.reshape(-1, *grid.shape[-3:]).astype(float)
    h, w = grid.shape[1:3]
    for step in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (step - w + 2) // 2), min(h - 1, step // 2) + 1)
        x = step - 2 * y
        old = grid[:, y, x]
        new = colours[((colours - old[:, :, None]) ** 2).sum(axis=3).argmin(axis=2)]
        grid[:, y, x] = new
        for dx, dy, part in ((-1, 1, 3), (1, 0, 7), (0, 1, 5), (1, 1, 1)):
            on = (x + dx >= 0) & (x + dx < w) & (y + dy < h)
            to = (slice(None), y[on] + dy, x[on] + dx)
            cells = grid[to]
            cells[:, :, :3] = np.clip(cells[:, :, :3] + (old - new)[:, on, :3] * part / 16, 0, 255)
            grid[to] = cells
    return grid.astype(np.int64).reshape(shape)


def dither(pixels: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """Error diffusion 7/16, 3/16, 5/16, 1/16 row by row to the nearest palette colour by squared distance. A canvas is at most
    4096 x 4096 and is settled in width + 2 height steps."""
    colours = np.array(palette, float)
    return _whole(pixels, lambda grid, there: dithered(grid, colours))


def extract_palette(pixels: DataFrame, most: int = 16) -> DataFrame:
    """Median cut: canvas, at, r, g, b, a. Boxes of opaque pixels are halved at the median of their widest channel.

    All boxes of all canvases are halved at once, level by level, by ranks inside the box; among equals of the channel the
    order of the level before holds, at first by row and column. Canvases without opaque pixels have no palette.
    """
    rows = pixels.filter("a > 0").select("canvas", *RGBA, F.lit(0).cast("long").alias("box"), F.struct("y", "x").alias("at"))
    for _ in range(max(0, int(np.ceil(np.log2(most))))):
        box = Window.partitionBy("canvas", "box")
        spans = [(F.max(c).over(box) - F.min(c).over(box)).alias(f"span_{c}") for c in "rgb"]
        rows = rows.select("*", *spans, F.count(F.lit(1)).over(box).alias("n"))
        widest = F.when((F.col("span_r") >= F.col("span_g")) & (F.col("span_r") >= F.col("span_b")), F.col("r")).when(F.col("span_g") >= F.col("span_b"), F.col("g")).otherwise(F.col("b"))
        rows = rows.withColumn("value", widest).withColumn("rank", F.row_number().over(box.orderBy("value", "at")))
        rows = rows.select("canvas", *RGBA, (2 * F.col("box") + F.when(F.col("rank") > F.floor(F.col("n") / 2), F.when(F.col("n") > 1, 1).otherwise(0)).otherwise(0)).alias("box"), F.struct(F.col("rank").alias("y"), F.lit(0).alias("x")).alias("at"))
    means = rows.groupBy("canvas", "box").agg(*[F.floor(F.sum(c) / F.count(F.lit(1))).cast("int").alias(c) for c in RGBA])
    numbered = means.withColumn("at", F.row_number().over(Window.partitionBy("canvas").orderBy("box")) - 1)
    return numbered.filter(F.col("at") < most).select("canvas", "at", *RGBA)


def encode_png(grid: np.ndarray) -> bytes:
    """RGBA rows as a PNG file."""
    h, w = grid.shape[:2]
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    raw = b"".join(b"\0" + row.tobytes() for row in grid.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 6, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_png(pixels: DataFrame) -> DataFrame:
    """canvas, png (binary)."""
    return pixels.groupBy("canvas").applyInPandas(lambda key, pdf: pd.DataFrame({"canvas": [key[0]], "png": [encode_png(_grids(pdf))]}), "canvas long, png binary")


def from_images(images: DataFrame) -> DataFrame:
    """Pixels of the rows of Spark's image source (BGR or BGRA bytes); canvas is a hash of the origin."""

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.int64)
                grid = np.full((r.height, r.width, 4), 255, np.int64)
                grid[:, :, :3] = raw[:, :, 2::-1] if r.nChannels >= 3 else raw[:, :, :1]
                if r.nChannels == 4:
                    grid[:, :, 3] = raw[:, :, 3]
                yield _frame(r.canvas, grid)

    return images.select(F.xxhash64("image.origin").alias("canvas"), "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(opened, SCHEMA)

