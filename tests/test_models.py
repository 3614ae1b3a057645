"""Batches on models against the same edits on plain dictionaries."""

import copy
import random

import pytest

from tarnstone.operators import models as M
from tarnstone.operators import rig as R


class Stop(Exception):
    pass


def bone(model, name):
    for b in model["bones"]:
        if b["name"] == name:
            return b
    raise Stop("no such bone")


def free(model, name, said):
    if any(b["name"] == name for b in model["bones"]):
        raise Stop(said)


def cube(b, at):
    if at >= len(b["cubes"]):
        raise Stop("no such cube")
    return b["cubes"][at]


def flip(v):
    return v and [-v[0], *v[1:]]


def run(model, o):
    """One operation on {bones: [{name, parent, pivot, rotation, cubes, locators}], size}."""
    kind = o["op"]
    if kind == "set_texture_size":
        model["size"] = (o["tex_width"], o["tex_height"])
    elif kind == "add_bone":
        free(model, o["bone_name"], "the bone exists")
        model["bones"].append({"name": o["bone_name"], "parent": o.get("parent"), "pivot": o.get("pivot", [0, 0, 0]), "rotation": o.get("rotation"), "cubes": [], "locators": {}})
    else:
        b = bone(model, o["bone_name"])
        if kind == "remove_bone":
            gone, more = {b["name"]}, True
            while o.get("cascade", True) and more:
                more = {x["name"] for x in model["bones"] if x["parent"] in gone} - gone
                gone |= more
            model["bones"] = [x for x in model["bones"] if x["name"] not in gone]
        elif kind == "rename_bone":
            free(model, o["new_name"], "the name is taken")
            for x in model["bones"]:
                if x["parent"] == o["bone_name"]:
                    x["parent"] = o["new_name"]
            b["name"] = o["new_name"]
        elif kind == "set_bone_transform":
            b |= {c: o[c] for c in ("pivot", "rotation") if o.get(c)}
        elif kind == "add_cube":
            b["cubes"].append({"origin": o["origin"], "size": o["size"], "uv": o["uv"], "inflate": o.get("inflate"), "rotation": o.get("cube_rotation"), "pivot": o.get("cube_pivot"), "mirror": None})
        elif kind == "remove_cube":
            cube(b, o["cube_index"])
            del b["cubes"][o["cube_index"]]
        elif kind == "edit_cube":
            c = cube(b, o["cube_index"])
            c |= {k: o[n] for k, n in (("origin", "origin"), ("size", "size"), ("uv", "uv"), ("inflate", "inflate"), ("rotation", "cube_rotation"), ("pivot", "cube_pivot")) if o.get(n) is not None}
        elif kind == "mirror_bone":
            free(model, o["new_name"], "the name is taken")
            new = copy.deepcopy(b)
            new |= {"name": o["new_name"], "pivot": flip(b["pivot"])}
            for c in new["cubes"]:
                c |= {"origin": [-c["origin"][0] - c["size"][0], *c["origin"][1:]], "pivot": flip(c["pivot"]), "mirror": True if o.get("mirror_uv", True) else c["mirror"]}
            model["bones"].append(new)
        elif kind == "add_locator":
            b["locators"][o["locator_name"]] = o["position"]


def plain(models, ops):
    out, failed = {}, {}
    for name, model in models.items():
        new = copy.deepcopy(model)
        try:
            for at, o in enumerate(ops):
                run(new, o)
        except Stop as e:
            new, failed[name] = model, (at, str(e))
        out[name] = new
    return out, failed


def read(g):
    models = {r.model: {"bones": {}, "size": (r.texture_width, r.texture_height)} for r in g.models.collect()}
    for r in g.bones.collect():
        assert r.bone not in models[r.model]["bones"]
        models[r.model]["bones"][r.bone] = {"parent": r.parent, "pivot": r.pivot, "rotation": r.rotation, "cubes": {}, "locators": {}}
    for r in g.cubes.collect():
        models[r.model]["bones"][r.bone]["cubes"][r.idx] = {c: r[c] for c in ("origin", "size", "uv", "inflate", "rotation", "pivot", "mirror")}
    for r in g.locators.collect():
        models[r.model]["bones"][r.bone]["locators"][r.locator] = r.position
    return models


def listed(models):
    return {n: {"size": m["size"], "bones": {b["name"]: {k: b[k] for k in ("parent", "pivot", "rotation", "locators")} | {"cubes": dict(enumerate(b["cubes"]))} for b in m["bones"]}} for n, m in models.items()}


def some_ops(rnd, names, n):
    vector = lambda: [float(rnd.randint(-9, 9)) for _ in range(3)]
    out = []
    for _ in range(n):
        name, new = rnd.choice(names), rnd.choice(names)
        o = {"op": rnd.choice(["add_bone", "remove_bone", "rename_bone", "set_bone_transform", "add_cube", "add_cube", "add_cube", "remove_cube", "edit_cube", "mirror_bone", "set_texture_size", "add_locator"]), "bone_name": name}
        o |= {"new_name": new + "2", "cascade": rnd.random() < 0.5, "parent": new, "pivot": vector(), "rotation": vector() if rnd.random() < 0.5 else None, "origin": vector(), "size": vector(), "uv": "[1, 2]", "cube_index": rnd.randint(0, 1)}
        o |= {"cube_rotation": vector() if rnd.random() < 0.5 else None, "cube_pivot": vector() if rnd.random() < 0.5 else None, "inflate": rnd.choice([None, 0.5]), "mirror_uv": rnd.random() < 0.5, "tex_width": 8, "tex_height": rnd.randint(1, 9), "locator_name": "at", "position": vector()}
        out.append(o)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    wanted = spark.createDataFrame([("m1", "quadruped", 64, 32), ("m2", "humanoid", 16, 16), ("m3", "sword", 1, 1)], "model string, template string, texture_width int, texture_height int")
    start = M.from_templates(wanted)
    models = {r.model: {"bones": [], "size": (r.texture_width, r.texture_height)} for r in wanted.collect()}
    for r in wanted.collect():
        models[r.model]["bones"] = [{"name": b, "parent": p, "pivot": [float(x) for x in at], "rotation": None, "cubes": [], "locators": {}} for b, p, at in M.TEMPLATES[r.template]]
    ops = [{"op": "add_cube", "bone_name": "root", "origin": [1.0, 2.0, 3.0], "size": [4.0, 5.0, 6.0], "uv": "[0, 0]"}]
    # Operations that run on one model at least, so that batches get somewhere.
    while len(ops) < 9:
        more = some_ops(rnd, ["root", "body", "head", "leg0", "blade", "tail", "root2", "x"], 1)
        if len(plain(models, ops + more)[1]) < 3:
            ops += more
    want, failed = plain(models, ops)
    g, told = M.apply_model_ops(start, ops)
    assert {r.model: (r.at, r.reason) for r in told.collect()} == failed
    assert read(g) == listed(want)


def test_wrong_batches_raise(spark):
    g = M.from_templates(spark.createDataFrame([("m", "blank", 1, 1)], "model string, template string, texture_width int, texture_height int"))
    for o in ({"op": "none"}, {"op": "add_cube", "bone_name": "root", "origin": [0, 0, 0], "size": [1, 1, 1]}, {"op": "rename_bone", "bone_name": "root"}, {}):
        with pytest.raises(ValueError):
            M.apply_model_ops(g, [{"op": "set_texture_size"}, o])
    assert [r.bone for r in M.apply_model_ops(g, [])[0].bones.collect()] == ["root"]


def test_mirrored_rotation(spark):
    rows = [("a", "l", "rotation", 0.0, 1.0), ("a", "l", "rotation", 0.75, 2.0), ("a", "r", "rotation", 0.1, 9.0), ("a", "l", "scale", 0.0, 5.0), ("b", "l", "rotation", None, 3.0), ("b", "r", "position", 0.0, 4.0), ("c", "r", "rotation", 0.0, 6.0)]
    k = spark.createDataFrame(rows, "anim string, bone string, channel string, t double, value double")
    got = {tuple(r) for r in R.mirror_rotation(k, "l", "r", 0.5, 1.0).collect()}
    assert got == {r for r in rows if r[:3] != ("a", "r", "rotation")} | {("a", "r", "rotation", 0.5, -1.0), ("a", "r", "rotation", 0.25, -2.0), ("b", "r", "rotation", None, -3.0)}
