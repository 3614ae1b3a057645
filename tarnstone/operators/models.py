"""Batches of edits on many models at once, each batch whole or not at all for a model.

A Geometry has four tables. bones: model, bone, parent, pivot, rotation. cubes: model, bone, idx, origin, size, uv (JSON text),
inflate, rotation, pivot, mirror. locators: model, bone, locator, position. models: model, texture_width, texture_height.
Vectors are arrays of three numbers; rotations, pivots of cubes, inflate and mirror may be null. A bone's name is unique in
its model, and a cube's idx in its bone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.operators.rig import descendants
from tarnstone.sources.files import stored

BONES = "model string, bone string, parent string, pivot array<double>, rotation array<double>"
CUBES = "model string, bone string, idx long, origin array<double>, size array<double>, uv string, inflate double, rotation array<double>, pivot array<double>, mirror boolean"
LOCATORS = "model string, bone string, locator string, position array<double>"
MODELS = "model string, texture_width int, texture_height int"
FAILURES = "model string, at int, reason string"
#: Operations after which the tables are written, so that a long batch has no long plan.
EVERY = 4
#: The bones of the model templates, each with its parent and pivot.
TEMPLATES: dict[str, list[tuple[str, str | None, tuple[float, float, float]]]] = {
    "blank": [("root", None, (0, 0, 0))],
    "humanoid": [
        ("root", None, (0, 0, 0)), ("waist", "root", (0, 12, 0)), ("body", "waist", (0, 24, 0)), ("head", "body", (0, 24, 0)), ("hat", "head", (0, 24, 0)),
        ("cape", "body", (0, 24, 3)), ("leftArm", "body", (5, 22, 0)), ("leftSleeve", "leftArm", (5, 22, 0)), ("leftItem", "leftArm", (6, 15, 1)),
        ("rightArm", "body", (-5, 22, 0)), ("rightSleeve", "rightArm", (-5, 22, 0)), ("rightItem", "rightArm", (-6, 15, 1)), ("leftLeg", "root", (1.9, 12, 0)),
        ("leftPants", "leftLeg", (1.9, 12, 0)), ("rightLeg", "root", (-1.9, 12, 0)), ("rightPants", "rightLeg", (-1.9, 12, 0)), ("jacket", "body", (0, 24, 0)),
    ],
    "sword": [("root", None, (0, 0, 0)), ("handle", "root", (0, 0, 0)), ("guard", "root", (0, 4, 0)), ("blade", "root", (0, 8, 0))],
    "item_flat": [("root", None, (0, 0, 0)), ("item", "root", (0, 0, 0))],
    "quadruped": [
        ("root", None, (0, 0, 0)), ("body", "root", (0, 12, 0)), ("head", "body", (0, 14, 8)), ("tail", "body", (0, 12, -8)),
        ("leg0", "body", (-3, 6, 7)), ("leg1", "body", (3, 6, 7)), ("leg2", "body", (-3, 6, -5)), ("leg3", "body", (3, 6, -5)),
    ],
}


@dataclass(frozen=True)
class Geometry:
    bones: DataFrame
    cubes: DataFrame
    locators: DataFrame
    models: DataFrame

    def each(self, use: Callable[[DataFrame], DataFrame]) -> Geometry:
        return Geometry(*[use(t) for t in (self.bones, self.cubes, self.locators, self.models)])

    def written(self) -> Geometry:
        return self.each(lambda t: stored(t, "geometry"))


def from_templates(wanted: DataFrame) -> Geometry:
    """The models that a table asks for (model, template, texture_width, texture_height); an unknown template gives no bones."""
    spark = wanted.sparkSession
    rows = [(t, b, p, [float(x) for x in at]) for t, bones in TEMPLATES.items() for b, p, at in bones]
    known = spark.createDataFrame(rows, "template string, bone string, parent string, pivot array<double>")
    bones = wanted.select("model", "template").join(F.broadcast(known), "template").select("model", "bone", "parent", "pivot", F.lit(None).cast("array<double>").alias("rotation"))
    models = wanted.select("model", F.col("texture_width").cast("int").alias("texture_width"), F.col("texture_height").cast("int").alias("texture_height"))
    return Geometry(bones, spark.createDataFrame([], CUBES), spark.createDataFrame([], LOCATORS), models)


def _vector(value: Any, column: str | None = None) -> Column:
    """A constant vector, or the column where none is given."""
    if value is None:
        return F.col(column) if column else F.lit(None).cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in value])


def _flipped(vector: str) -> Column:
    """x changes its side, in the single precision that models have."""
    return F.transform(F.col(vector), lambda v, i: F.when(i == 0, (-v.cast("float")).cast("double")).otherwise(v))


class Batch:
    """One operation at a time on all models in which it may run."""

    def __init__(self, g: Geometry):
        self.g = g

    def having(self, bone: str) -> DataFrame:
        return self.g.bones.filter(F.col("bone") == bone).select("model")

    def lacking(self, bone: str) -> DataFrame:
        return self.g.models.select("model").join(self.having(bone), "model", "left_anti")

    def without_cube(self, bone: str, idx: int) -> DataFrame:
        return self.g.models.select("model").join(self.g.cubes.filter((F.col("bone") == bone) & (F.col("idx") == idx)).select("model"), "model", "left_anti")

    # Each operation: (what stands against it, as tables of models with a reason; the geometry after it).

    def add_bone(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        new = self.g.models.select("model", F.lit(o["bone_name"]).alias("bone"), F.lit(o.get("parent") or None).cast("string").alias("parent"), _vector(o.get("pivot") or (0, 0, 0)).alias("pivot"), _vector(o.get("rotation")).alias("rotation"))
        return [(self.having(o["bone_name"]), "the bone exists")], replace(self.g, bones=self.g.bones.unionByName(new))

    def remove_bone(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        """With all under it, unless cascade is false; what hangs on removed bones goes with them."""
        bone = o["bone_name"]
        gone = self.having(bone).withColumn("bone", F.lit(bone))
        if o.get("cascade", True):
            # One tree for all models: the bone is its top in each, all others are told apart by their model.
            named = lambda c: F.when(F.col(c) == bone, "\u0001").when(F.col(c).isNotNull(), F.concat("model", F.lit("\u0000"), F.col(c)))
            tree = self.g.bones.select(named("bone").alias("bone"), named("parent").alias("parent"))
            under = F.split("bone", "\u0000", 2)
            gone = gone.unionByName(descendants(tree, "\u0001").select(under[0].alias("model"), under[1].alias("bone")))
        kept = lambda t: t.join(gone, ["model", "bone"], "left_anti").select(*t.columns)
        return [(self.lacking(bone), "no such bone")], replace(self.g, bones=kept(self.g.bones), cubes=kept(self.g.cubes), locators=kept(self.g.locators))

    def rename_bone(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        old, new = o["bone_name"], o["new_name"]
        named = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
        bones = self.g.bones.withColumns({"bone": named("bone"), "parent": named("parent")})
        return [(self.lacking(old), "no such bone"), (self.having(new), "the name is taken")], replace(self.g, bones=bones, cubes=self.g.cubes.withColumn("bone", named("bone")), locators=self.g.locators.withColumn("bone", named("bone")))

    def set_bone_transform(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        here = F.col("bone") == o["bone_name"]
        bones = self.g.bones.withColumns({c: F.when(here, _vector(o.get(c), c)).otherwise(F.col(c)) for c in ("pivot", "rotation")})
        return [(self.lacking(o["bone_name"]), "no such bone")], replace(self.g, bones=bones)

    def add_cube(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        bone = o["bone_name"]
        last = self.g.cubes.filter(F.col("bone") == bone).groupBy("model").agg((F.max("idx") + 1).alias("next"))
        new = self.having(bone).join(last, "model", "left").select(
            "model", F.lit(bone).alias("bone"), F.coalesce("next", F.lit(0)).cast("long").alias("idx"), _vector(o["origin"]).alias("origin"), _vector(o["size"]).alias("size"), F.lit(o["uv"]).alias("uv"),
            F.lit(o.get("inflate")).cast("double").alias("inflate"), _vector(o.get("cube_rotation")).alias("rotation"), _vector(o.get("cube_pivot")).alias("pivot"), F.lit(None).cast("boolean").alias("mirror"),
        )
        return [(self.lacking(bone), "no such bone")], replace(self.g, cubes=self.g.cubes.unionByName(new))

    def remove_cube(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        """Later cubes of the bone move up."""
        here, at = F.col("bone") == o["bone_name"], F.col("idx")
        cubes = self.g.cubes.filter(~(here & (at == o["cube_index"]))).withColumn("idx", F.when(here & (at > o["cube_index"]), at - 1).otherwise(at))
        return [(self.lacking(o["bone_name"]), "no such bone"), (self.without_cube(o["bone_name"], o["cube_index"]), "no such cube")], replace(self.g, cubes=cubes)

    def edit_cube(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        here = (F.col("bone") == o["bone_name"]) & (F.col("idx") == o["cube_index"])
        new = {c: _vector(o.get(k), c) for c, k in (("origin", "origin"), ("size", "size"), ("rotation", "cube_rotation"), ("pivot", "cube_pivot"))}
        new |= {c: F.lit(o[c]).cast(kind) for c, kind in (("uv", "string"), ("inflate", "double")) if o.get(c) is not None}
        cubes = self.g.cubes.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})
        return [(self.lacking(o["bone_name"]), "no such bone"), (self.without_cube(o["bone_name"], o["cube_index"]), "no such cube")], replace(self.g, cubes=cubes)

    def mirror_bone(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        """A copy on the other side of x = 0: the bone's and its cubes' pivots and the cubes' places change their side; rotations,
        textures and locators are copied; cubes are marked as mirrored unless mirror_uv is false."""
        bone, new = o["bone_name"], o["new_name"]
        copied = lambda t: t.filter(F.col("bone") == bone).withColumn("bone", F.lit(new))
        single = lambda c: F.get(c, F.lit(0)).cast("float")
        side = F.transform(F.col("origin"), lambda v, i: F.when(i == 0, (-single("origin") - single("size")).cast("double")).otherwise(v))
        cubes = copied(self.g.cubes).withColumns({"origin": F.when(F.size("size") > 0, side).otherwise(F.col("origin")), "pivot": _flipped("pivot")})
        cubes = cubes.withColumn("mirror", F.lit(True)) if o.get("mirror_uv", True) else cubes
        g = Geometry(self.g.bones.unionByName(copied(self.g.bones).withColumn("pivot", _flipped("pivot"))), self.g.cubes.unionByName(cubes), self.g.locators.unionByName(copied(self.g.locators)), self.g.models)
        return [(self.lacking(bone), "no such bone"), (self.having(new), "the name is taken")], g

    def set_texture_size(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        sizes = {c: F.lit(int(o.get(k, 64))) for c, k in (("texture_width", "tex_width"), ("texture_height", "tex_height"))}
        return [], replace(self.g, models=self.g.models.withColumns(sizes))

    def add_locator(self, o: dict) -> tuple[list[tuple[DataFrame, str]], Geometry]:
        """In place of one of the same name on the bone."""
        bone, name = o["bone_name"], o["locator_name"]
        new = self.having(bone).select("model", F.lit(bone).alias("bone"), F.lit(name).alias("locator"), _vector(o["position"]).alias("position"))
        left = self.g.locators.filter(~((F.col("bone") == bone) & (F.col("locator") == name)))
        return [(self.lacking(bone), "no such bone")], replace(self.g, locators=left.unionByName(new))


#: What each operation requires.
NEEDS = {
    "add_bone": ("bone_name",), "remove_bone": ("bone_name",), "rename_bone": ("bone_name", "new_name"), "set_bone_transform": ("bone_name",), "add_cube": ("bone_name", "origin", "size", "uv"),
    "remove_cube": ("bone_name", "cube_index"), "edit_cube": ("bone_name", "cube_index"), "mirror_bone": ("bone_name", "new_name"), "set_texture_size": (), "add_locator": ("bone_name", "locator_name", "position"),
}


def apply_model_ops(g: Geometry, ops: list[dict]) -> tuple[Geometry, DataFrame]:
    """(the models after a batch of operations, failures: model, at, reason).

    An operation runs on all models at once. A model in which one cannot run keeps all it had, and is told with the place of
    the first such operation; other models go on. An unknown operation or a missing argument raises before anything runs.
    """
    for at, o in enumerate(ops):
        if o.get("op") not in NEEDS:
            raise ValueError(f"operation {at}: unknown operation {o.get('op')!r}")
        if missing := [k for k in NEEDS[o["op"]] if o.get(k) in (None, "")]:
            raise ValueError(f"operation {at}: {o['op']} needs {', '.join(missing)}")
    now, failed = g, stored(g.models.sparkSession.createDataFrame([], FAILURES), "geometry")
    for at, o in enumerate(ops):
        against, after = getattr(Batch(now), o["op"])(o)
        told = None
        for models, reason in against:
            one = models.distinct().select("model", F.lit(at).alias("at"), F.lit(reason).alias("reason"))
            told = one if told is None else told.unionByName(one.join(told.select("model"), "model", "left_anti"))
        now = after
        if told is not None:
            # Written at once, so that plans grow with the operations and do not double with each.
            told = stored(told, "geometry-failed")
            if not told.isEmpty():
                failed = failed.unionByName(told)
                now = after.each(lambda t, gone=told: t.join(gone.select("model"), "model", "left_anti"))
        if at % EVERY == EVERY - 1:
            now = now.written()
    tables = zip((now.bones, now.cubes, now.locators, now.models), (g.bones, g.cubes, g.locators, g.models), strict=True)
    out = [new.unionByName(old.join(failed.select("model"), "model", "left_semi")) for new, old in tables]
    return Geometry(*out), failed
