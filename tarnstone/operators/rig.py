"""Skeletal geometry (bones, cubes) and keyframe animation as tables.

bones: bone, parent, pivot_x, pivot_y, pivot_z. cubes: bone, idx, ox, oy, oz, sx, sy, sz. locators: bone, locator, x, y, z.
models: model, texture_width, texture_height. animations: anim, prop, value (JSON text). keyframes: anim, bone, channel,
t (seconds; null: a constant), value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.sources.files import stored

CHANNELS = ("rotation", "position", "scale")

def descendants(bones: DataFrame, top: str) -> DataFrame:
    """bone, depth of all bones under top.

    Pointer jumping: each bone points to an ancestor and knows how far it is; in each round all pointers double their reach,
    and those to top, to a bone without a parent or to a parent that does not exist stay. So the rounds grow with the logarithm
    of the depth, each is written before the next, and no count of rows or levels ends them; bones in a circle are under no top.
    """
    known = bones.select(F.col("bone").alias("up"), F.when(F.col("bone") != top, F.col("parent")).alias("next")).dropDuplicates(["up"])
    jumps = bones.filter(F.col("bone") != top).select("bone", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    step = known.filter("next IS NOT NULL").select("up", "next", F.lit(1).cast("long").alias("more"))
    for _ in range(bones.count().bit_length() + 1):
        jumps, step = stored(jumps, "bones"), stored(step, "bone-steps")
        if jumps.join(step, "up", "left_semi").isEmpty():
            break
        new = jumps.join(step, "up", "left")
        jumps = new.select("bone", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        far = step.select(F.col("up").alias("next"), F.col("next").alias("far"), F.col("more").alias("further"))
        step = step.join(far, "next", "left").select("up", F.coalesce("far", "next").alias("next"), (F.col("more") + F.coalesce("further", F.lit(0))).alias("more"))
    return jumps.filter(F.col("up") == top).select("bone", "depth")


def add_bone(bones: DataFrame, bone: str, parent: str | None, pivot: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The bone joins only if no bone has its name."""
    new = bones.sparkSession.createDataFrame([(bone, parent, *map(float, pivot))], "bone string, parent string, pivot_x double, pivot_y double, pivot_z double")
    return bones.unionByName(new.join(bones.select("bone"), "bone", "left_anti"))


def remove_bone(bones: DataFrame, bone: str, cascade: bool = True) -> DataFrame:
    """Without cascade the children stay as orphans."""
    left = bones.filter(F.col("bone") != bone)
    return left.join(descendants(bones, bone).select("bone"), "bone", "left_anti") if cascade else left


def rename_bone(bones: DataFrame, old: str, new: str) -> DataFrame:
    named = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return bones.select(*[named(c) if c in ("bone", "parent") else c for c in bones.columns])


def set_pivot(bones: DataFrame, bone: str, pivot: tuple[float, float, float]) -> DataFrame:
    return bones.withColumns({f"pivot_{a}": F.when(F.col("bone") == bone, float(v)).otherwise(F.col(f"pivot_{a}")) for a, v in zip("xyz", pivot, strict=True)})


def add_cube(cubes: DataFrame, new: DataFrame) -> DataFrame:
    """new cubes (without idx) go behind the cubes of their bone."""
    last = cubes.groupBy("bone").agg((F.max("idx") + 1).alias("next"))
    placed = new.join(last, "bone", "left").withColumn("idx", F.coalesce("next", F.lit(0)).cast("long")).drop("next")
    return cubes.unionByName(placed.select(*cubes.columns))


def remove_cube(cubes: DataFrame, bone: str, idx: int) -> DataFrame:
    """Later cubes of the bone move up."""
    left = cubes.filter(~((F.col("bone") == bone) & (F.col("idx") == idx)))
    return left.withColumn("idx", F.when((F.col("bone") == bone) & (F.col("idx") > idx), F.col("idx") - 1).otherwise(F.col("idx")))


def edit_cube(cubes: DataFrame, bone: str, idx: int, **fields: float) -> DataFrame:
    """The cube with the given columns replaced; others stay as they are."""
    here = (F.col("bone") == bone) & (F.col("idx") == idx)
    return cubes.withColumns({c: F.when(here, F.lit(v).cast(dict(cubes.dtypes)[c])).otherwise(F.col(c)) for c, v in fields.items()})


def mirror_bones(bones: DataFrame) -> DataFrame:
    """The pivot changes its side; rotation does not."""
    return bones.withColumn("pivot_x", (-F.col("pivot_x").cast("float")).cast("double"))


def mirror_cubes(cubes: DataFrame) -> DataFrame:
    f = lambda c: F.col(c).cast("float")
    return cubes.withColumn("ox", (-f("ox") - f("sx")).cast("double"))


def mirror_bone(bones: DataFrame, cubes: DataFrame, locators: DataFrame, bone: str, new: str, mirror_uv: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with a copy of the bone under a new name on the other side of x = 0: pivot and cubes mirrored, the cubes'
    texture marked as mirrored if asked, locators and parent as they are. Nothing is added if the new name is taken or the bone
    does not exist."""
    free = bones.filter(F.col("bone") == new).select(F.lit(bone).alias("bone"))
    source = bones.filter(F.col("bone") == bone).join(free, "bone", "left_anti")
    copied = lambda rows: rows.join(source.select("bone"), "bone", "left_semi").withColumn("bone", F.lit(new))
    more = mirror_cubes(copied(cubes))
    more = more.withColumn("mirror", F.lit(True)) if mirror_uv and "mirror" in cubes.columns else more
    return bones.unionByName(mirror_bones(copied(bones))), cubes.unionByName(more.select(*cubes.columns)), locators.unionByName(copied(locators).select(*locators.columns))


def add_locator(locators: DataFrame, new: DataFrame, bones: DataFrame) -> DataFrame:
    """locators with new ones in place of those of the same bone and name; bones that do not exist get none."""
    new = new.join(bones.select("bone"), "bone", "left_semi").select(*locators.columns)
    return locators.join(new.select("bone", "locator"), ["bone", "locator"], "left_anti").unionByName(new)


def set_texture_size(models: DataFrame, model: str, width: int, height: int) -> DataFrame:
    new = {"texture_width": width, "texture_height": height}
    return models.withColumns({c: F.when(F.col("model") == model, F.lit(v).cast(dict(models.dtypes)[c])).otherwise(F.col(c)) for c, v in new.items()})


def model_summary(bones: DataFrame, cubes: DataFrame) -> DataFrame:
    n = cubes.groupBy("bone").agg(F.count(F.lit(1)).alias("cubes"))
    return bones.join(n, "bone", "left").select("bone", "parent", F.coalesce("cubes", F.lit(0)).cast("long").alias("cubes"))


def apply_ops(bones: DataFrame, ops: list[dict]) -> DataFrame:
    """A batch of bone operations, in order; a wrong one raises before anything runs."""
    known = {
        "add_bone": lambda b, o: add_bone(b, o["bone_name"], o.get("parent"), o.get("pivot", (0, 0, 0))),
        "remove_bone": lambda b, o: remove_bone(b, o["bone_name"], o.get("cascade", True)),
        "rename_bone": lambda b, o: rename_bone(b, o["bone_name"], o["new_name"]),
        "set_bone_transform": lambda b, o: set_pivot(b, o["bone_name"], o["pivot"]),
    }
    for o in ops:
        if o.get("op") not in known:
            raise ValueError(f"unknown operation {o.get('op')!r}")
    for o in ops:
        bones = known[o["op"]](bones, o)
    return bones


def time_text(t: float) -> str:
    """Four significant digits without trailing zeros."""
    return f"{t:.4g}"


def ordered_keyframes(keyframes: DataFrame) -> DataFrame:
    """With at: the place of a keyframe in its channel; times that are numbers come first, in order, then the rest as text."""
    number = F.expr("try_cast(t AS double)")
    return keyframes.withColumn("at", F.row_number().over(Window.partitionBy("anim", "bone", "channel").orderBy(number.asc_nulls_last(), F.col("t").cast("string"))).cast("long"))


def upsert_keyframes(keyframes: DataFrame, new: DataFrame) -> DataFrame:
    key = ["anim", "bone", "channel", "t"]
    return keyframes.join(new.select(*key), key, "left_anti").unionByName(new.select(*keyframes.columns))


def delete_keyframes(keyframes: DataFrame, gone: DataFrame) -> DataFrame:
    """A channel or bone without keyframes has no row, so emptied ones vanish by themselves."""
    return keyframes.join(gone, ["anim", "bone", "channel", "t"], "left_anti")


def phase_shift(keyframes: DataFrame, phase: float, length: float) -> DataFrame:
    """Mirrored rotation: the value changes its sign and times move by phase, modulo length where that is positive.

    Keyframes that fall on one time keep the one that came last.
    """
    moved = F.col("t") + phase
    moved = F.pmod(moved, F.lit(float(length))) if length > 0 else moved
    shifted = keyframes.withColumn("from_t", F.col("t")).withColumn("t", F.round(moved, 6)).withColumn("value", -F.col("value"))
    return shifted.groupBy("anim", "bone", "channel", "t").agg(F.max_by("value", "from_t").alias("value"))


def mirror_rotation(keyframes: DataFrame, source: str, target: str, phase: float = 0.0, length: float = 0.0) -> DataFrame:
    """The target bone's rotation in place of what it had: the source's, with its sign changed, moved in time by phase (modulo
    length where that is positive); a constant stays one. In animations in which the source has no rotation, nothing changes."""
    turned = keyframes.filter((F.col("bone") == source) & (F.col("channel") == "rotation"))
    moved = phase_shift(turned.filter("t IS NOT NULL"), phase, length).select(*keyframes.columns).unionByName(turned.filter("t IS NULL").withColumn("value", -F.col("value")).select(*keyframes.columns))
    new = moved.withColumn("bone", F.lit(target))
    there = turned.select("anim", F.lit(target).alias("bone"), F.lit("rotation").alias("channel")).distinct()
    return keyframes.join(there, ["anim", "bone", "channel"], "left_anti").select(*keyframes.columns).unionByName(new)


def scale_time(keyframes: DataFrame, factor: float) -> DataFrame:
    if factor <= 0:
        raise ValueError("the factor must be positive")
    return keyframes.withColumn("t", F.col("t") * factor)


def anim_summary(keyframes: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """A row an animation and bone, with a count of keyframes for each channel."""
    counts = [F.count_if(F.col("channel") == c).alias(c) for c in channels]
    return keyframes.groupBy("anim", "bone").agg(*counts, F.max("t").alias("length"))


#: The properties of an animation that can be set.
ANIM_PROPS = ("loop", "animation_length", "blend_weight", "override_previous_animation", "anim_time_update", "start_delay", "loop_delay")


def add_anim(animations: DataFrame, anim: str, loop: str = "false", length: float = 0.0) -> DataFrame:
    """A new animation joins only if none has its name; a length of 0 is not noted."""
    rows = [(anim, "loop", loop)] + ([(anim, "animation_length", f"{length:g}")] if length > 0 else [])
    new = animations.sparkSession.createDataFrame(rows, "anim string, prop string, value string")
    return animations.unionByName(new.join(animations.select("anim"), "anim", "left_anti"))


def remove_anim(rows: DataFrame, anim: str) -> DataFrame:
    """For the table of animations and for that of keyframes."""
    return rows.filter(F.col("anim") != anim)


def set_anim_prop(animations: DataFrame, anim: str, prop: str, value: str) -> DataFrame:
    if prop not in ANIM_PROPS:
        raise ValueError(f"unknown property {prop!r}")
    there = animations.filter(F.col("anim") == anim).select("anim").distinct().select("anim", F.lit(prop).alias("prop"), F.lit(value).alias("value"))
    return animations.filter(~((F.col("anim") == anim) & (F.col("prop") == prop))).unionByName(there)


def set_constant(keyframes: DataFrame, new: DataFrame) -> DataFrame:
    """new (anim, bone, channel, value) in place of all keyframes of the channel, as rows without a time."""
    left = keyframes.join(new, ["anim", "bone", "channel"], "left_anti")
    return left.unionByName(new.withColumn("t", F.lit(None).cast("double")).select(*keyframes.columns))


def remove_channel(keyframes: DataFrame, anim: str, bone: str, channel: str = "") -> DataFrame:
    """Without a channel, all of the bone go."""
    here = (F.col("anim") == anim) & (F.col("bone") == bone)
    return keyframes.filter(~(here & (F.col("channel") == channel) if channel else here))


def apply_anim_ops(animations: DataFrame, keyframes: DataFrame, ops: list[dict]) -> tuple[DataFrame, DataFrame]:
    """A batch of animation operations on both tables, in order; a wrong one raises before anything runs."""
    one = lambda k, o: k.sparkSession.createDataFrame([(o["anim"], o["bone"], o["channel"], float(o["value"]))], "anim string, bone string, channel string, value double")
    known = {
        "add_anim": lambda a, k, o: (add_anim(a, o["anim"], o.get("loop", "false"), o.get("length", 0.0)), k),
        "remove_anim": lambda a, k, o: (remove_anim(a, o["anim"]), remove_anim(k, o["anim"])),
        "set_anim_prop": lambda a, k, o: (set_anim_prop(a, o["anim"], o["prop"], o["value"]), k),
        "set_keyframe": lambda a, k, o: (a, upsert_keyframes(k, one(k, o).withColumn("t", F.lit(float(o["t"]))))),
        "set_constant": lambda a, k, o: (a, set_constant(k, one(k, o))),
        "remove_keyframe": lambda a, k, o: (a, k.filter(~((F.col("anim") == o["anim"]) & (F.col("bone") == o["bone"]) & (F.col("channel") == o["channel"]) & F.coalesce(F.col("t") == float(o["t"]), F.lit(False))))),
        "remove_bone_channel": lambda a, k, o: (a, remove_channel(k, o["anim"], o["bone"], o.get("channel", ""))),
        "mirror_bone_rotation": lambda a, k, o: (a, mirror_rotation(k.filter(F.col("anim") == o["anim"]), o["source_bone"], o["target_bone"], o.get("phase_offset", 0.0), o.get("anim_length", 0.0)).unionByName(k.filter(F.col("anim") != o["anim"]))),
        "scale_time": lambda a, k, o: (a, scale_time(k.filter(F.col("anim") == o["anim"]), o["factor"]).unionByName(k.filter(F.col("anim") != o["anim"]))),
    }
    for o in ops:
        if o.get("op") not in known:
            raise ValueError(f"unknown operation {o.get('op')!r}")
    for o in ops:
        animations, keyframes = known[o["op"]](animations, keyframes, o)
    return animations, keyframes
