"""Small fixtures and properties of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnstone.functions import segment as G
from tarnstone.functions import text as T
from tarnstone.operators import jsontree as J
from tarnstone.operators import raster as R
from tarnstone.operators import rig as B
from tarnstone.sources.files import parse_json


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_text(spark):
    assert one(spark, "Foo_bar, 12-baz é", T.tokenize_en) == ["foo_bar", "12", "baz"]
    for word, want in (("OnPlayerAttackEvent", True), ("onplayerattackevent", False), ("PlayerEvent", False)):
        assert one(spark, word, T.precise_identifier) is want
    assert one(spark, "PlayerAttackEvent", lambda c: T.identifier_score(c, "player")) == 989
    assert one(spark, "OnPlayerEvent", lambda c: T.identifier_score(c, "player")) == 598
    assert one(spark, "a PlayerEvent MobDieEvent2 x", T.longest_identifier) == "MobDieEvent2"
    assert one(spark, "x/接口/y.md", T.classify_path) == "API" and one(spark, "BedrockWiki/beta/y", T.classify_path) == "Wiki"


def test_raster(spark):
    rnd = np.random.default_rng(1)
    rows = [(0, x, y, *map(int, rnd.integers(0, 256, 3)), int(rnd.choice([0, 255]))) for x in range(5) for y in range(3)]
    p = spark.createDataFrame(rows, R.SCHEMA)
    same = lambda d: sorted(map(tuple, d.collect())) == sorted(rows)
    assert same(R.flip(R.flip(p, True, 5, 3), True, 5, 3)) and same(R.rotate90(p, 4, 5, 3))
    assert [r.r for r in R.gradient(R.new_canvas(spark, 4, 1), 0, 0, 4, 1, (0, 0, 0, 255), (255, 0, 0, 255)).orderBy("x").collect()] == [0, 85, 170, 255]
    assert R.from_hex("#ff000080") == (255, 0, 0, 128)
    with pytest.raises(ValueError):
        R.new_canvas(spark, 0, 5)
    assert R.line_cells(3, 1, 3, 1) == [(3, 1)] and (5, 3) in R.circle_cells(3, 3, 2, False)


def test_png_round_trip(spark, tmp_path):
    grid = np.random.default_rng(2).integers(0, 256, (4, 3, 4))
    grid[:, :, 3] = 255
    (tmp_path / "a.png").write_bytes(R.encode_png(grid))
    got = R.from_images(spark.read.format("image").load(str(tmp_path))).collect()
    assert {(r.x, r.y): (r.r, r.g, r.b) for r in got} == {(x, y): tuple(map(int, grid[y, x, :3])) for x in range(3) for y in range(4)}


def test_rig(spark):
    assert B.time_text(12.3456) == "12.35" and B.time_text(0.0) == "0"
    k = spark.createDataFrame([("a", "b", "rotation", 0.9, 3.0)], "anim string, bone string, channel string, t double, value double")
    got = B.phase_shift(k, 0.5, 1.0).first()
    assert (got.t, got.value) == (0.4, -3.0)
    c = spark.createDataFrame([("b", 0, 2.0, 3.0)], "bone string, idx long, ox double, sx double")
    assert B.mirror_cubes(c).first().ox == -5.0 and B.mirror_cubes(B.mirror_cubes(c)).first().ox == 2.0
    with pytest.raises(ValueError):
        B.scale_time(k, 0)


def test_patches():
    tree = {"namespace": "n", "top@x": {"type": "panel", "controls": [{"a@b": {"type": "label"}}]}}
    new = J.apply_patches(tree, [{"op": "set_prop", "path": "top/a", "key": "layer", "value": 3}, {"op": "add_ctrl", "path": "top", "key": "z", "before": "a"}, {"op": "merge_ctrl", "path": "top/a", "value": {"type": "image", "controls": []}, "new_key": "c"}])
    assert [list(e)[0] for e in new["top@x"]["controls"]] == ["z", "c"] and new["top@x"]["controls"][1]["c"] == {"type": "image", "layer": 3}
    with pytest.raises(J.PatchError) as e:
        J.apply_patches(tree, [{"op": "remove_top", "key": "top"}, {"op": "remove_ctrl", "path": "none", "key": "a"}])
    assert e.value.index == 1 and "top@x" in tree
    assert parse_json('{"a": "//x", /* c */ "b": 1, "b": 2} // end') == {"a": "//x", "b": 2}


def test_segmenter():
    s = G.Segmenter(G.Lexicon.parse(["今天 5 t", "天气 5 n", "今天天气 9 n", "好 5 a"]))
    assert s.mp("今天天气好") == ["今天天气", "好"] and s.search("今天天气好") == ["今天", "天气", "今天天气", "好"]
    assert s.full("今天天气好") == ["今天", "今天天气", "天气", "好"] and s.small("今天天气好", 2) == ["今天", "天气", "好"]
    assert s.tags("好12") == [("好", "a"), ("1", "m"), ("2", "m")] and s.lexicon.delete("好") and not s.lexicon.find("好")
    assert G.fnv1a(b"") == "cbf29ce484222325" and G.fnv1a(b"a") == "af63dc4c8601ec8c"
    w = G.textrank(["a", "b", "a", "c"])
    assert max(w.values()) == 1.0 and max(w, key=w.get) == "a"


def test_sparse_canvases_gain_no_places(spark):
    from tarnstone.operators import raster

    rows = [(1, x, y, 9, 9, 9, 255) for x, y in [(0, 0), (1, 0), (3, 0), (0, 2)]]
    got = raster.flood_fill(spark.createDataFrame(rows, raster.SCHEMA), 0, 0, (1, 2, 3, 255)).collect()
    assert {(r.x, r.y): r.r for r in got} == {(0, 0): 1, (1, 0): 1, (3, 0): 9, (0, 2): 9}


def test_dithering_is_that_of_row_by_row():
    def plain(grid, colours):
        grid = grid.astype(float)
        h, w = grid.shape[:2]
        for y in range(h):
            for x in range(w):
                old = grid[y, x].copy()
                new = colours[np.argmin(((colours - old) ** 2).sum(axis=1))]
                grid[y, x] = new
                for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        cell = grid[y + dy, x + dx]
                        cell[:3] = np.clip(cell[:3] + (old - new)[:3] * part / 16, 0, 255)
        return grid.astype(np.int64)

    rnd = np.random.default_rng(4)
    for h, w, k in ((1, 1, 2), (1, 9, 2), (9, 1, 3), (2, 2, 2), (13, 17, 5), (30, 8, 1)):
        grid, colours = rnd.integers(0, 256, (h, w, 4)), rnd.integers(0, 256, (k, 4)).astype(float)
        assert (R.dithered(grid, colours) == plain(grid, colours)).all()
    from time import perf_counter

    begin = perf_counter()
    R.dithered(rnd.integers(0, 256, (400, 400, 4)), rnd.integers(0, 256, (16, 4)).astype(float))
    assert perf_counter() - begin < 5


def test_median_cut(spark):
    rnd = np.random.default_rng(6)
    rows = [(c, x, y, *map(int, rnd.integers(0, 8, 3)), int(rnd.choice([0, 255]))) for c in (1, 2) for x in range(9) for y in range(5)] + [(3, 0, 0, 1, 2, 3, 255), (4, 0, 0, 1, 2, 3, 0)]
    for most in (1, 3, 8, 64):
        want = []
        for c in (1, 2, 3):
            boxes = [np.array([r[3:] for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[0] == c and r[6] > 0])]
            for _ in range(int(np.ceil(np.log2(most)))):
                split = []
                for box in boxes:
                    if len(box) > 1:
                        box = box[np.argsort(box[:, int(np.argmax(np.ptp(box[:, :3], axis=0)))], kind="stable")]
                        split += [box[: len(box) // 2], box[len(box) // 2 :]]
                    else:
                        split.append(box)
                boxes = split
            want += [(c, i, *(b.sum(axis=0) // len(b)).tolist()) for i, b in enumerate(boxes[:most])]
        assert sorted(map(tuple, R.extract_palette(spark.createDataFrame(rows, R.SCHEMA), most).collect())) == want


def test_thousands_of_rectangles(spark):
    rnd = np.random.default_rng(8)
    w, h = 70, 50
    grid = np.zeros((3, h, w, 4), int)
    rows = []
    for seq in range(3000):
        c, x, y, rw, rh, filled = int(rnd.integers(0, 3)), int(rnd.integers(-20, 80)), int(rnd.integers(-20, 60)), int(rnd.integers(0, 60)), int(rnd.integers(-1, 60)), bool(rnd.integers(0, 2))
        colour = tuple(map(int, rnd.integers(0, 256, 4)))
        rows.append((c, seq, x, y, rw, rh, filled, *colour))
        ys, xs = np.mgrid[0:h, 0:w]
        hit = (xs >= x) & (xs < x + rw) & (ys >= y) & (ys < y + rh)
        grid[c][hit if filled else hit & ((xs == x) | (xs == x + rw - 1) | (ys == y) | (ys == y + rh - 1))] = colour
    pixels = R.new_canvas(spark, w, h, canvas=0).unionByName(R.new_canvas(spark, w, h, canvas=1)).unionByName(R.new_canvas(spark, w, h, canvas=2))
    commands = spark.createDataFrame(rows, "canvas long, seq long, x int, y int, w int, h int, filled boolean, r int, g int, b int, a int")
    out = R.rects(pixels, commands, 16)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    got = out.toPandas()
    assert len(got) == 3 * w * h and (grid[got["canvas"], got["y"], got["x"]] == got[["r", "g", "b", "a"]].to_numpy()).all()


def test_exploded_rectangles_and_pixels_are_not_broadcast(spark, tmp_path):
    """The plan took them for as few as the files they come from, and the driver had to hold all of them."""
    rnd = np.random.default_rng(12)
    rows = [(int(rnd.integers(0, 3)), seq, *map(int, rnd.integers(-4, 12, 2)), *map(int, rnd.integers(0, 9, 2)), [True, False, None][seq % 3], *map(int, rnd.integers(0, 256, 4))) for seq in range(4000)]
    spark.createDataFrame(rows, "canvas long, seq long, x int, y int, w int, h int, filled boolean, r int, g int, b int, a int").write.parquet(str(tmp_path / "commands"))
    places = [(c, x, y) for c in (0, 1, 4) for x in range(8) for y in range(11) if c != 1 or (x + y) % 3]
    spark.createDataFrame([(*p, 1, 2, 3, 4) for p in places], R.SCHEMA).write.parquet(str(tmp_path / "pixels"))
    want = {p: (1, 2, 3, 4) for p in places}
    for c, _, x, y, w, h, filled, *colour in rows:
        for i in range(x, x + w):
            for j in range(y, y + h):
                if (c, i, j) in want and (filled is not False or i in (x, x + w - 1) or j in (y, y + h - 1)):
                    want[c, i, j] = tuple(colour)
    for tile in (1, 3, 4, 32):
        out = R.rects(spark.read.parquet(str(tmp_path / "pixels")), spark.read.parquet(str(tmp_path / "commands")), tile)
        joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "Inner" in line]
        assert len(joins) == 2 and not any("Broadcast" in line for line in joins), joins
        got = out.collect()
        assert len(got) == len(places) and {r[:3]: r[3:] for r in map(tuple, got)} == want


def test_query_tokens_by_mode():
    """The decision table: text kind by mode, in both phases; a segmenter that finds nothing falls back to English."""
    from tarnstone.operators.search import query_tokens

    def cut(text):
        return [c for c in text if not c.isascii()]

    rows = [
        ("Set_Pos x", "auto", False, ["set_pos", "x"]), ("Set_Pos x", "auto", True, ["set_pos", "x"]), ("?!", "auto", False, []),
        ("Set 位置", "auto", False, ["位", "置"]), ("Set 位置", "english", False, ["set"]), ("Set 位置", "prefer_english_fallback", False, ["位", "置"]),
        ("Set 位置", "prefer_english_fallback", True, ["set"]), ("Set Pos", "prefer_english_fallback", False, ["set", "pos"]), ("", "auto", False, []),
    ]
    for text, mode, second, want in rows:
        assert query_tokens(text, mode, second, cut) == want, (text, mode, second)
    assert query_tokens("Set 位置") == ["set"]


def test_line_rules_on_a_tree_in_one_line(spark):
    """Each "size" of a line was followed to the line's end, which takes the square of its length."""
    from time import perf_counter

    from tarnstone.operators.jsontree import line_lints

    long = '{"size":[1,20]},' * 60_000
    rows = [(1, long), (2, long + '"size": "100%+5px"'), (3, '"x": "3%-4", "size": 5'), (4, '"size": 5\r"x": "3%+4"'), (5, '"size": 1\r "size": "9%-1"'), (6, "// \"size\": 3%+4"), (7, None)]
    begin = perf_counter()
    assert [r.line_no for r in line_lints(spark.createDataFrame(rows, "line_no int, line string")).filter("rule = 'spacing'").orderBy("line_no").collect()] == [2, 5]
    assert perf_counter() - begin < 30


def test_canvases_are_settled_in_stacks(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(c, x, y, *map(int, rnd.integers(0, 256, 4))) for c in (None, 2**62 + 1, 2**62 + 2, *range(40)) for x in range((c or 0) % 3 + 1) for y in range(4) if (x, y) == (0, 3) or rnd.random() < 0.8]
    pixels = spark.createDataFrame(rows, R.SCHEMA).repartition(3)
    palette = [(0, 0, 0, 255), (255, 255, 255, 255), (128, 64, 0, 255)]
    grids = {}
    for c, x, y, *v in rows:
        grids.setdefault(c, np.zeros((4, 1 + max(r[1] for r in rows if r[0] == c), 4), np.int64))[y, x] = v
    want = {c: R.dithered(g, np.array(palette, float)) for c, g in grids.items()}
    monkeypatch.setattr(R, "STACK", 64)
    got = R.dither(pixels, palette).collect()
    assert len(got) == len(rows) and all(tuple(want[r.canvas][r.y, r.x]) == r[3:] for r in got)
    plan = R.dither(pixels, palette)._jdf.queryExecution().optimizedPlan().toString() + R.flood_fill(pixels, 0, 3, (1, 2, 3, 4))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    filled = R.flood_fill(pixels, 0, 3, (1, 2, 3, 255), 500).collect()
    assert len(filled) == len(rows) and all(r[3:] == (1, 2, 3, 255) for r in filled if (r.x, r.y) == (0, 3))
    assert sum(r[3:] == (1, 2, 3, 255) for r in filled) > len(grids)
