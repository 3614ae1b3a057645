"""Queries over geometry and animation: suppliers and parts stand for bones and cubes, events for keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.operators import models as M
from tarnstone.operators import rig as R
from tarnstone.plans.base import query

ON = ("region", "nation", "supplier")
BONES = """bones AS (SELECT r_name AS bone, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey AS DOUBLE) AS pivot_x, 0.0::DOUBLE AS pivot_y, 0.0::DOUBLE AS pivot_z FROM region
UNION ALL SELECT n_name, r_name, n_nationkey / 2.0, 1.0, 0.0 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, n_name, CAST(s_suppkey AS DOUBLE), 2.0, 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def bones(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    d = lambda c: F.lit(c).cast("double")
    top = region.select(F.col("r_name").alias("bone"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("double").alias("pivot_x"), d(0).alias("pivot_y"), d(0).alias("pivot_z"))
    mid = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("bone"), F.col("r_name").alias("parent"), (F.col("n_nationkey") / 2).alias("pivot_x"), d(1).alias("pivot_y"), d(0).alias("pivot_z"))
    low = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_name").alias("bone"), F.col("n_name").alias("parent"), F.col("s_suppkey").cast("double").alias("pivot_x"), d(2).alias("pivot_y"), d(1).alias("pivot_z"))
    return top.unionByName(mid).unionByName(low)


CUBES = "cubes AS (SELECT 'b' || (p_partkey % 40) AS bone, CAST(row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) - 1 AS BIGINT) AS idx, CAST(p_size AS DOUBLE) AS ox, CAST(p_partkey % 7 AS DOUBLE) AS sx FROM part)"


def cubes(part: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 40).orderBy("p_partkey")) - 1
    return part.select(F.concat(F.lit("b"), (F.col("p_partkey") % 40).cast("string")).alias("bone"), at.cast("long").alias("idx"), F.col("p_size").cast("double").alias("ox"), (F.col("p_partkey") % 7).cast("double").alias("sx"))


K_SQL = """k AS (SELECT 'a' || (user_id % 3) AS anim, 'u' || user_id AS bone, CASE event_id % 3 WHEN 0 THEN 'rotation' WHEN 1 THEN 'position' ELSE 'scale' END AS channel,
CAST(event_id % 20 AS DOUBLE) / 4 AS t, max(value) AS value FROM events GROUP BY ALL)"""


def keyframes(events: DataFrame) -> DataFrame:
    channel = F.when(F.col("event_id") % 3 == 0, "rotation").when(F.col("event_id") % 3 == 1, "position").otherwise("scale")
    at = [F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("anim"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("bone"), channel.alias("channel"), ((F.col("event_id") % 20).cast("double") / 4).alias("t")]
    return events.groupBy(*at).agg(F.max("value").alias("value"))


@query("bone_lookup", f"WITH {BONES} SELECT * FROM bones WHERE bone = 'ASIA'", *ON)
def _(*t):
    return bones(*t).filter("bone = 'ASIA'")


@query("bone_json", f"WITH {BONES} SELECT bone, '{{\"name\":\"' || bone || '\",\"parent\":\"' || parent || '\"}}' AS json FROM bones WHERE parent = 'ASIA'", *ON)
def _(*t):
    return bones(*t).filter("parent = 'ASIA'").select("bone", F.to_json(F.struct(F.col("bone").alias("name"), "parent")).alias("json"))


@query("bone_defaults", f"WITH {BONES} SELECT bone, coalesce(parent, 'none') AS parent FROM bones", *ON)
def _(*t):
    return bones(*t).select("bone", F.coalesce("parent", F.lit("none")).alias("parent"))


@query("descendants", f"WITH RECURSIVE {BONES}, d(bone, depth) AS (SELECT bone, 1 FROM bones WHERE parent = 'ASIA' UNION ALL SELECT b.bone, d.depth + 1 FROM bones b JOIN d ON b.parent = d.bone) SELECT bone, CAST(depth AS BIGINT) AS depth FROM d", *ON)
def _(*t):
    return R.descendants(bones(*t), "ASIA").select("bone", F.col("depth").cast("long").alias("depth"))


@query("bone_add", f"WITH {BONES} SELECT bone, parent FROM bones UNION ALL SELECT 'NEW', 'ASIA'", *ON)
def _(*t):
    return R.add_bone(R.add_bone(bones(*t), "NEW", "ASIA"), "ASIA", None).select("bone", "parent")


@query("bone_remove_cascade", f"WITH {BONES} SELECT bone, parent FROM bones WHERE bone <> 'ASIA' AND coalesce(parent, '') <> 'ASIA' AND bone NOT IN (SELECT bone FROM bones WHERE parent IN (SELECT bone FROM bones WHERE parent = 'ASIA'))", *ON)
def _(*t):
    return R.remove_bone(bones(*t), "ASIA").select("bone", "parent")


@query("bone_rename", f"WITH {BONES} SELECT CASE bone WHEN 'ASIA' THEN 'A' ELSE bone END AS bone, CASE parent WHEN 'ASIA' THEN 'A' ELSE parent END AS parent FROM bones", *ON)
def _(*t):
    return R.rename_bone(bones(*t), "ASIA", "A").select("bone", "parent")


@query("bone_transform", f"WITH {BONES} SELECT bone, CASE WHEN bone = 'ASIA' THEN 9.0 ELSE pivot_x END AS pivot_x FROM bones", *ON)
def _(*t):
    return R.set_pivot(bones(*t), "ASIA", (9, 8, 7)).select("bone", "pivot_x")


@query("op_batch", f"WITH {BONES} SELECT CASE bone WHEN 'EUROPE' THEN 'E' ELSE bone END AS bone, CASE parent WHEN 'EUROPE' THEN 'E' ELSE parent END AS parent FROM bones WHERE bone <> 'ASIA' UNION ALL SELECT 'N', 'E'", *ON)
def _(*t):
    ops = [{"op": "remove_bone", "bone_name": "ASIA", "cascade": False}, {"op": "rename_bone", "bone_name": "EUROPE", "new_name": "E"}, {"op": "add_bone", "bone_name": "N", "parent": "E"}]
    return R.apply_ops(bones(*t), ops).select("bone", "parent")


@query("mirror_bone", f"WITH {CUBES} SELECT bone, idx, -ox - sx AS ox FROM cubes", "part")
def _(part):
    return R.mirror_cubes(cubes(part)).select("bone", "idx", "ox")


@query("cube_edit", f"WITH {CUBES} SELECT bone, CASE WHEN bone = 'b3' AND idx > 1 THEN idx - 1 ELSE idx END AS idx, ox FROM cubes WHERE NOT (bone = 'b3' AND idx = 1) UNION ALL SELECT 'b5', count(*), 77.0 FROM cubes WHERE bone = 'b5'", "part")
def _(part):
    c = cubes(part).select("bone", "idx", "ox")
    new = part.sparkSession.createDataFrame([("b5", 77.0)], "bone string, ox double")
    return R.add_cube(R.remove_cube(c, "b3", 1), new)


@query("cube_set", f"WITH {CUBES} SELECT bone, idx, CASE WHEN bone = 'b7' AND idx = 2 THEN 5.5 ELSE ox END AS ox, CASE WHEN bone = 'b7' AND idx = 2 THEN 3.0 ELSE sx END AS sx FROM cubes", "part")
def _(part):
    return R.edit_cube(cubes(part), "b7", 2, ox=5.5, sx=3)


def _locators(nation):
    return nation.select(F.col("n_name").alias("bone"), F.lit("held").alias("locator"), F.col("n_nationkey").cast("double").alias("x"))


@query("locator_add", """SELECT n_name AS bone, 'held' AS locator, CASE WHEN n_regionkey = 1 THEN 9.0 ELSE n_nationkey END AS x FROM nation
UNION ALL SELECT n_name, 'lead', 9.0 FROM nation WHERE n_regionkey = 2""", *ON)
def _(region, nation, supplier):
    held = nation.filter("n_regionkey = 1").select(F.col("n_name").alias("bone"), F.lit("held").alias("locator"), F.lit(9.0).alias("x"))
    lead = nation.filter("n_regionkey = 2").select(F.col("n_name").alias("bone"), F.lit("lead").alias("locator"), F.lit(9.0).alias("x"))
    nowhere = nation.sparkSession.createDataFrame([("no such bone", "held", 1.0)], "bone string, locator string, x double")
    return R.add_locator(_locators(nation), held.unionByName(lead).unionByName(nowhere), bones(region, nation, supplier))


@query("mirror_symmetry", f"""WITH {BONES}, c AS (SELECT s_name AS bone, 0 AS idx, CAST(s_suppkey AS DOUBLE) AS ox, 2.0 AS sx FROM supplier)
SELECT bone, parent, pivot_x, ox FROM bones LEFT JOIN c USING (bone) UNION ALL
SELECT 'twin', parent, -pivot_x, -ox - sx FROM bones JOIN c USING (bone) WHERE bone = (SELECT min(s_name) FROM supplier)""", *ON)
def _(region, nation, supplier):
    c = supplier.select(F.col("s_name").alias("bone"), F.lit(0).alias("idx"), F.col("s_suppkey").cast("double").alias("ox"), F.lit(2.0).alias("sx"))
    name = supplier.agg(F.min("s_name")).first()[0]
    b, c, _ = R.mirror_bone(bones(region, nation, supplier), c, _locators(nation), name, "twin")
    b, c, _ = R.mirror_bone(b, c, _locators(nation), "ASIA", "EUROPE")  # the name is taken
    return b.join(c, "bone", "left").select("bone", "parent", "pivot_x", "ox")


@query("texture_size", "SELECT p_brand AS model, CASE WHEN p_brand = 'Brand#12' THEN 64 ELSE max(p_size) END AS texture_width, CASE WHEN p_brand = 'Brand#12' THEN 32 ELSE min(p_size) END AS texture_height FROM part GROUP BY p_brand", "part")
def _(part):
    models = part.groupBy(F.col("p_brand").alias("model")).agg(F.max("p_size").alias("texture_width"), F.min("p_size").alias("texture_height"))
    return R.set_texture_size(models, "Brand#12", 64, 32)


@query("model_summary", f"WITH {CUBES} SELECT bone, count(*) AS cubes FROM cubes GROUP BY bone", "part")
def _(part):
    c = cubes(part)
    b = c.select("bone").distinct().withColumn("parent", F.lit(None).cast("string"))
    return R.model_summary(b, c).select("bone", "cubes")


KIND = "CASE p_size % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'humanoid' WHEN 2 THEN 'sword' WHEN 3 THEN 'item_flat' ELSE 'quadruped' END"
TEMPLATE_ROWS = ", ".join(f"('{t}', '{b}', {p!r}, {[float(x) for x in at]})".replace("None", "NULL") for t, rows in M.TEMPLATES.items() for b, p, at in rows)


def _kinds(part):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("blank", "humanoid", "sword", "item_flat", "quadruped")]), (F.col("p_size") % 5 + 1).cast("int"))
    return part.select(F.col("p_partkey").cast("string").alias("model"), kind.alias("template"), F.lit(64).alias("texture_width"), F.col("p_size").alias("texture_height"))


@query("model_template", f"SELECT CAST(p_partkey AS VARCHAR) AS model, bone, parent, CAST(place[1] AS DOUBLE) AS x, CAST(place[2] AS DOUBLE) AS y, CAST(place[3] AS DOUBLE) AS z FROM (SELECT *, {KIND} AS template FROM part) JOIN (VALUES {TEMPLATE_ROWS}) t(template, bone, parent, place) USING (template)", "part")
def _(part):
    """A model for each part, from the template that its size names."""
    bones = M.from_templates(_kinds(part)).bones
    return bones.select("model", "bone", "parent", *[F.col("pivot")[i].alias(c) for i, c in enumerate("xyz")])


#: On models with a leg2 all operations run; swords, flat and blank items and humanoids fail at the one for leg2.
OPS = [
    {"op": "set_texture_size", "tex_width": 32, "tex_height": 16}, {"op": "add_cube", "bone_name": "root", "origin": [1, 2, 3], "size": [4, 5, 6], "uv": "[0, 8]", "cube_pivot": [7, 0, 0]},
    {"op": "add_cube", "bone_name": "root", "origin": [0, 0, 0], "size": [2, 2, 2], "uv": "[1, 1]", "inflate": 0.5}, {"op": "mirror_bone", "bone_name": "root", "new_name": "twin"},
    {"op": "mirror_bone", "bone_name": "leg2", "new_name": "leg4"}, {"op": "edit_cube", "bone_name": "root", "cube_index": 1, "size": [3, 3, 3], "cube_rotation": [0, 45, 0]},
    {"op": "remove_cube", "bone_name": "root", "cube_index": 0}, {"op": "rename_bone", "bone_name": "body", "new_name": "trunk"}, {"op": "set_bone_transform", "bone_name": "leg4", "rotation": [0, 0, 90]},
    {"op": "add_locator", "bone_name": "head", "locator_name": "eye", "position": [0, 15, 9]}, {"op": "remove_bone", "bone_name": "tail"}, {"op": "add_bone", "bone_name": "flag", "parent": "trunk", "pivot": [0, 1, 2]},
]


@query("model_batch", f"""WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS model, {KIND} AS template FROM part), b AS (SELECT model, template, bone, parent, place FROM w JOIN (VALUES {TEMPLATE_ROWS}) t(template, bone, parent, place) USING (template)),
n AS (SELECT model, CASE bone WHEN 'body' THEN 'trunk' ELSE bone END AS bone, CASE parent WHEN 'body' THEN 'trunk' ELSE parent END AS parent, place, NULL AS turn FROM b WHERE template = 'quadruped' AND bone <> 'tail'
UNION ALL SELECT model, 'leg4', 'trunk', [3.0, 6.0, -5.0], 90.0 FROM w WHERE template = 'quadruped' UNION ALL SELECT model, 'twin', NULL, [0.0, 0.0, 0.0], NULL FROM w WHERE template = 'quadruped'
UNION ALL SELECT model, 'flag', 'trunk', [0.0, 1.0, 2.0], NULL FROM w WHERE template = 'quadruped' UNION ALL SELECT model, bone, parent, place, NULL FROM b WHERE template <> 'quadruped')
SELECT model, bone, parent, CAST(place[1] AS DOUBLE) AS x, CAST(place[2] AS DOUBLE) AS y, CAST(place[3] AS DOUBLE) AS z, CAST(turn AS DOUBLE) AS turn FROM n""", "part")
def _(part):
    """Bones of all models after one batch; models in which an operation cannot run keep what they had."""
    bones = M.apply_model_ops(M.from_templates(_kinds(part)), OPS)[0].bones
    return bones.select("model", "bone", "parent", *[F.col("pivot")[i].alias(c) for i, c in enumerate("xyz")], F.get("rotation", F.lit(2)).alias("turn"))


@query("model_batch_cubes", f"""WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS model, {KIND} AS template FROM part)
SELECT model, c.* FROM w, (VALUES ('root', 0, 0.0::DOUBLE, 3.0::DOUBLE, '[1, 1]', 0.5::DOUBLE, CAST(NULL AS DOUBLE), 45.0::DOUBLE, CAST(NULL AS BOOLEAN)), ('twin', 0, -5.0, 4.0, '[0, 8]', NULL, -7.0, NULL, true), ('twin', 1, -2.0, 2.0, '[1, 1]', 0.5, NULL, NULL, true))
c(bone, idx, x, width, uv, inflate, pivot_x, turn, mirror) WHERE template = 'quadruped'""", "part")
def _(part):
    """Cubes of the same batch."""
    cubes = M.apply_model_ops(M.from_templates(_kinds(part)), OPS)[0].cubes
    at = lambda c, i: F.get(c, F.lit(i))
    return cubes.select("model", "bone", F.col("idx").cast("int").alias("idx"), at("origin", 0).alias("x"), at("size", 0).alias("width"), "uv", "inflate", at("pivot", 0).alias("pivot_x"), at("rotation", 1).alias("turn"), "mirror")


@query("model_batch_failures", f"""WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS model, {KIND} AS template, p_size FROM part)
SELECT model, CASE WHEN template = 'quadruped' THEN NULL ELSE 4 END AS at, CASE WHEN template = 'quadruped' THEN NULL ELSE 'no such bone' END AS reason, CASE WHEN template = 'quadruped' THEN 32 ELSE 64 END AS texture_width, CASE WHEN template = 'quadruped' THEN 16 ELSE CAST(p_size AS INTEGER) END AS texture_height FROM w""", "part")
def _(part):
    """Where the batch failed, and each model's texture size after it."""
    g, failed = M.apply_model_ops(M.from_templates(_kinds(part)), OPS)
    return g.models.join(failed, "model", "left").select("model", "at", "reason", "texture_width", "texture_height")


@query("anim_mirror", f"""WITH {K_SQL}, s AS (SELECT anim, round((t + 0.5) % 4.0, 6) AS t2, arg_max(-value, t) AS v FROM k WHERE anim = 'a1' AND bone = 'u1' AND channel = 'rotation' GROUP BY anim, t2)
SELECT anim, bone, channel, t, value FROM k WHERE NOT (anim = 'a1' AND bone = 'u4' AND channel = 'rotation' AND EXISTS (SELECT 1 FROM s)) UNION ALL SELECT anim, 'u4', 'rotation', t2, v FROM s""", "events")
def _(events):
    """One bone's rotation mirrored onto another, in a batch."""
    k = keyframes(events)
    return R.apply_anim_ops(animations(k), k, [{"op": "mirror_bone_rotation", "anim": "a1", "source_bone": "u1", "target_bone": "u4", "phase_offset": 0.5, "anim_length": 4.0}])[1]


@query("keyframes", f"WITH {K_SQL} SELECT * FROM k WHERE channel = 'rotation'", "events")
def _(events):
    return keyframes(events).filter("channel = 'rotation'")


@query("keyframe_sort", f"WITH {K_SQL} SELECT anim, bone, channel, t, row_number() OVER (PARTITION BY anim, bone, channel ORDER BY t) AS at FROM k", "events")
def _(events):
    return R.ordered_keyframes(keyframes(events)).select("anim", "bone", "channel", "t", "at")


@query("keyframe_upsert", f"WITH {K_SQL} SELECT anim, bone, channel, t, CASE WHEN t = 1.0 THEN 0.0 ELSE value END AS value FROM k", "events")
def _(events):
    k = keyframes(events)
    return R.upsert_keyframes(k, k.filter("t = 1.0").withColumn("value", F.lit(0.0)))


@query("keyframe_delete", f"WITH {K_SQL} SELECT * FROM k WHERE NOT (channel = 'scale' AND t >= 2)", "events")
def _(events):
    k = keyframes(events)
    return R.delete_keyframes(k, k.filter("channel = 'scale' AND t >= 2").select("anim", "bone", "channel", "t"))


@query("phase_shift", f"WITH {K_SQL}, m AS (SELECT anim, bone, channel, round((t + 0.5) % 4.0, 6) AS t2, t, -value AS v FROM k) SELECT anim, bone, channel, t2 AS t, arg_max(v, t) AS value FROM m GROUP BY anim, bone, channel, t2", "events")
def _(events):
    return R.phase_shift(keyframes(events), 0.5, 4.0)


@query("time_scale", f"WITH {K_SQL} SELECT anim, bone, channel, t * 2.5 AS t, value FROM k", "events")
def _(events):
    return R.scale_time(keyframes(events), 2.5)


@query("anim_summary", f"WITH {K_SQL} SELECT anim, bone, count(*) FILTER (channel = 'rotation') AS rotation, count(*) FILTER (channel = 'position') AS position, count(*) FILTER (channel = 'scale') AS scale, max(t) AS length FROM k GROUP BY anim, bone", "events")
def _(events):
    return R.anim_summary(keyframes(events))


A_SQL = f"{K_SQL}, a AS (SELECT DISTINCT anim, 'loop' AS prop, 'true' AS value FROM k UNION ALL SELECT anim, 'animation_length', CAST(CAST(max(t) AS INTEGER) AS VARCHAR) FROM k GROUP BY anim)"


def animations(k: DataFrame) -> DataFrame:
    loop = k.select("anim", F.lit("loop").alias("prop"), F.lit("true").alias("value")).distinct()
    return loop.unionByName(k.groupBy("anim").agg(F.max("t").alias("t")).select("anim", F.lit("animation_length").alias("prop"), F.round("t").cast("int").cast("string").alias("value")))


@query("anim_prop", f"WITH {A_SQL} SELECT anim, prop, CASE WHEN anim = 'a1' AND prop = 'loop' THEN 'hold_on_last_frame' ELSE value END AS value FROM a UNION ALL SELECT 'a2', 'blend_weight', '0.5'", "events")
def _(events):
    a = R.set_anim_prop(animations(keyframes(events)), "a1", "loop", "hold_on_last_frame")
    return R.set_anim_prop(R.set_anim_prop(a, "a2", "blend_weight", "0.5"), "none", "loop", "true")


@query("anim_add", f"WITH {A_SQL} SELECT * FROM a WHERE anim <> 'a2' UNION ALL VALUES ('new', 'loop', 'false'), ('new', 'animation_length', '2.5')", "events")
def _(events):
    a = R.add_anim(R.add_anim(animations(keyframes(events)), "new", length=2.5), "a1", "hold_on_last_frame")
    return R.remove_anim(a, "a2")


@query("anim_constant", f"WITH {K_SQL} SELECT anim, bone, channel, t, value FROM k WHERE channel <> 'scale' UNION ALL SELECT DISTINCT anim, bone, 'scale', CAST(NULL AS DOUBLE), 1.0 FROM k WHERE channel = 'scale'", "events")
def _(events):
    k = keyframes(events)
    return R.set_constant(k, k.filter("channel = 'scale'").select("anim", "bone", "channel", F.lit(1.0).alias("value")).distinct())


@query("anim_batch", f"""WITH {K_SQL} SELECT anim, bone, channel, t, value FROM k WHERE anim = 'a0'
UNION ALL SELECT anim, bone, channel, t * 2, value FROM k WHERE anim = 'a1' AND bone <> 'u1' AND NOT (bone = 'u4' AND channel = 'scale')
UNION ALL VALUES ('a1', 'u4', 'scale', CAST(NULL AS DOUBLE), 2.0), ('a0', 'extra', 'position', 0.25, 7.0)""", "events")
def _(events):
    ops = [
        {"op": "remove_anim", "anim": "a2"}, {"op": "remove_bone_channel", "anim": "a1", "bone": "u1"}, {"op": "set_constant", "anim": "a1", "bone": "u4", "channel": "scale", "value": 2},
        {"op": "scale_time", "anim": "a1", "factor": 2.0}, {"op": "set_keyframe", "anim": "a0", "bone": "extra", "channel": "position", "t": 0.25, "value": 7},
        {"op": "set_keyframe", "anim": "a0", "bone": "extra", "channel": "position", "t": 0.5, "value": 8}, {"op": "remove_keyframe", "anim": "a0", "bone": "extra", "channel": "position", "t": 0.5},
    ]
    k = keyframes(events)
    return R.apply_anim_ops(animations(k), k, ops)[1]


@query("try_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(props->>'$.k' AS VARCHAR) ELSE 'math.sin(' || event_id || ')' END AS value FROM events", "events")
def _(events):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("math.sin("), F.col("event_id").cast("string"), F.lit(")")))
    return events.select("event_id", raw.alias("raw")).select("event_id", F.coalesce(F.expr("try_variant_get(try_parse_json(raw), '$.k', 'string')"), F.col("raw")).alias("value"))


@query("time_key", f"WITH {K_SQL} SELECT DISTINCT t, CASE WHEN t = 0 THEN '0' ELSE rtrim(rtrim(printf('%.4f', t), '0'), '.') END AS key FROM k", "events")
def _(events):
    times = keyframes(events).select("t").distinct()
    return times.mapInPandas(lambda parts: (p.assign(key=[R.time_text(x) for x in p["t"]]) for p in parts), "t double, key string")
