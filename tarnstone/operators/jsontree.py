"""JSON interface trees as node and property tables: walking, searching, linting and patching."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.sources.files import parse_json

#: The control types that are known.
TYPES = (
    "button", "collection_panel", "custom", "dropdown", "edit_box", "factory", "grid", "image", "input_panel", "label", "panel", "screen",
    "scroll_view", "scrollbar_box", "scroll_track", "selection_wheel", "slider", "slider_box", "stack_panel", "tab", "toggle",
)


WALKED = "doc_id long, path string, parent string, full string, bare string, base string, depth int, ord int, type string, node string"


def nodes_of(tree: object) -> Iterator[tuple]:
    """(path, parent, full, bare, base, depth, ord, type, node) of every control of one parsed document, each before its
    children. node is its JSON text without the children. Any depth: the open controls stand on a list, not on the call stack.
    """
    tops = [(None, k, v, 0, i) for i, (k, v) in enumerate(sorted(tree.items()))] if isinstance(tree, dict) else []
    open_ = tops[::-1]
    while open_:
        parent, full, node, depth, place = open_.pop()
        if not isinstance(node, dict):
            continue
        bare, _, base = full.partition("@")
        path = bare if parent is None else f"{parent}/{bare}"
        own = {k: v for k, v in node.items() if k != "controls"}
        kind = own.get("type")
        kind = kind if isinstance(kind, str) or kind is None else json.dumps(kind)
        yield path, parent, full, bare, base.split("@")[0] or None, depth, place, kind, json.dumps(own, ensure_ascii=False, separators=(",", ":"))
        entries = node.get("controls")
        if isinstance(entries, list):
            open_ += [(path, k, v, depth + 1, i) for i, e in enumerate(entries) if isinstance(e, dict) for k, v in sorted(e.items())][::-1]


def walk(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """doc_id, path, parent, full, bare, base, depth, ord, type, node (a variant) of every control.

    Bare keys make the path; base follows the @. A tree is one document, so one task walks it, from its top-level objects
    through their controls arrays, and no count of rows or levels ends the walk. Comments are allowed outside strings,
    repeated keys keep the last value, and a null text or one that does not parse has no nodes.
    """

    def walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                try:
                    tree = parse_json(text)
                except (ValueError, TypeError, RecursionError):
                    continue
                rows += [(doc, *n) for n in nodes_of(tree)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WALKED.split(", ")])

    out = docs.select("doc_id", F.col(json_col).alias("text")).filter("text IS NOT NULL").mapInPandas(walked, WALKED)
    return out.withColumn("node", F.parse_json("node"))


def properties(nodes: DataFrame) -> DataFrame:
    """doc_id, path, key, value (JSON text) of each control, without its children."""
    out = nodes.sparkSession.sql("SELECT n.doc_id, n.path, n.full, e.key, to_json(e.value) AS value FROM {n} n, LATERAL variant_explode(n.node) e WHERE e.key <> 'controls'", n=nodes)
    return out.withColumn("value", F.regexp_replace("value", '^"(.*)"$', "$1"))


def lookup(nodes: DataFrame, path: str) -> DataFrame:
    parts = [p.split("@")[0] for p in path.split("/") if p]
    return nodes.filter(F.col("path") == "/".join(parts))


def search_tree(nodes: DataFrame, props: DataFrame, pattern: str) -> DataFrame:
    """doc_id, path of controls whose key, path or any property value matches."""
    by_name = nodes.filter(F.col("path").rlike(f"(?i){pattern}")).select("doc_id", "path")
    return by_name.unionByName(props.filter(F.col("value").rlike(f"(?i){pattern}")).select("doc_id", "path")).distinct()


def search_content(nodes: DataFrame, props: DataFrame, pattern: str) -> DataFrame:
    """doc_id, path, key, value: matching properties, and matching controls with an empty key."""
    hit = lambda c: F.col(c).rlike(f"(?i){pattern}")
    named = nodes.filter(hit("full")).select("doc_id", "path", F.lit("").alias("key"), F.col("full").alias("value"))
    return props.filter(hit("key") | hit("value")).select("doc_id", "path", "key", "value").unionByName(named)


def tree_stats(nodes: DataFrame, pattern: str) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("controls"), F.max("depth").cast("long").alias("max_depth"), F.count_if(F.col("bare").rlike(pattern)).alias("hits"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """A row for each bare key that siblings repeat, with the surplus."""
    return nodes.filter("parent IS NOT NULL").groupBy("doc_id", "parent", "bare").agg((F.count(F.lit(1)) - 1).alias("surplus")).filter("surplus > 0")


def unknown_types(nodes: DataFrame) -> DataFrame:
    known = nodes.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    return nodes.filter("type IS NOT NULL").join(F.broadcast(known), "type", "left_anti").select("doc_id", "path", "type")


def _size(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "path", F.expr("try_variant_get(node, '$.size', 'array<double>')").alias("size")).filter("size IS NOT NULL")


def bad_sizes(nodes: DataFrame) -> DataFrame:
    """Sizes that are not two numbers (warning), and numbers over 100 among the first two (suggestion)."""
    size = _size(nodes)
    wrong = size.filter(F.size("size") != 2).select("doc_id", "path", F.lit("warning").alias("severity"))
    large = size.select("doc_id", "path", F.explode(F.slice("size", 1, 2)).alias("x")).filter("x > 100").select("doc_id", "path", F.lit("suggestion").alias("severity"))
    return wrong.unionByName(large)


def half_anchored(nodes: DataFrame) -> DataFrame:
    has = lambda k: F.expr(f"try_variant_get(node, '$.{k}', 'string') IS NOT NULL")
    return nodes.filter(has("anchor_from") != has("anchor_to")).select("doc_id", "path")


def hidden_labels(nodes: DataFrame) -> DataFrame:
    """Parents whose lowest label lies at or under their highest image."""
    layer = F.coalesce(F.expr("try_variant_get(node, '$.layer', 'int')"), F.lit(0))
    by = nodes.filter("parent IS NOT NULL").groupBy("doc_id", "parent").agg(F.min(F.when(F.col("type") == "label", layer)).alias("label"), F.max(F.when(F.col("type") == "image", layer)).alias("image"))
    return by.filter("label <= image").select("doc_id", "parent", F.col("label").cast("long").alias("label"), F.col("image").cast("long").alias("image"))


def anchored_stack_children(nodes: DataFrame) -> DataFrame:
    stack = nodes.filter("type = 'stack_panel'").select("doc_id", F.col("path").alias("parent")).distinct()
    child = nodes.filter(F.expr("try_variant_get(node, '$.anchor_from', 'string') IS NOT NULL OR try_variant_get(node, '$.offset', 'variant') IS NOT NULL"))
    return child.join(stack, ["doc_id", "parent"]).select("doc_id", "path")


def dangling_references(nodes: DataFrame) -> DataFrame:
    """Children whose base has no dot and is not a top-level key."""
    refs = nodes.filter("depth > 0 AND base IS NOT NULL AND NOT contains(base, '.')").select("doc_id", "path", "base")
    tops = nodes.filter("depth = 0").select("doc_id", F.col("bare").alias("base")).distinct()
    return refs.join(tops, ["doc_id", "base"], "left_anti").select("doc_id", "path", "base")


def missing_namespace(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Documents whose tree has no namespace, or no tree; comments are allowed."""

    @F.pandas_udf("boolean")
    def spaced(texts: pd.Series) -> pd.Series:
        def has(text: str | None) -> bool:
            try:
                tree = parse_json(text)
            except (ValueError, TypeError, RecursionError):
                return False
            return isinstance(tree, dict) and tree.get("namespace") is not None

        return texts.map(has)

    return docs.filter(~spaced(json_col)).select("doc_id")


def line_lints(lines: DataFrame) -> DataFrame:
    """line_no, rule of lines with a bound name that does not start with # or $, or a percentage that runs into its offset."""
    bound = F.regexp_extract("line", r'"binding_name"\s*:\s*"([^"]*)"', 1)
    # What follows the first "size" is looked at once: after each of them, a tree written in one line takes the square of its length.
    after = lambda x: F.substr(x, F.instr(x, '"size"') + 6).rlike("[0-9]%[+-][0-9]")
    spaced = F.exists(F.split("line", r"[\r\x{85}\x{2028}\x{2029}]"), lambda x: F.when(F.instr(x, '"size"') > 0, after(x)).otherwise(False))
    rule = F.when((bound != "") & ~bound.rlike("^[#$]"), "binding").when(spaced, "spacing")
    return lines.filter(~F.col("line").rlike(r"^\s*//")).withColumn("rule", rule).filter("rule IS NOT NULL")


def diagnose(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """doc_id, rule, place of all that the nine rules find: siblings of one key, unknown types, sizes, lone anchors, labels
    under images, placed children of stacks, dangling references, missing namespaces, and faulty lines."""
    nodes = walk(docs, json_col)
    lines = docs.select("doc_id", F.posexplode(F.split(json_col, "\n")).alias("line_no", "line"))
    found = {
        "duplicate_key": duplicate_keys(nodes).withColumn("place", F.concat_ws("/", "parent", "bare")),
        "unknown_type": unknown_types(nodes).withColumn("place", F.col("path")),
        "size": bad_sizes(nodes).withColumn("place", F.col("path")),
        "anchors": half_anchored(nodes).withColumn("place", F.col("path")),
        "layers": hidden_labels(nodes).withColumn("place", F.col("parent")),
        "stack_child": anchored_stack_children(nodes).withColumn("place", F.col("path")),
        "reference": dangling_references(nodes).withColumn("place", F.col("path")),
        "namespace": missing_namespace(docs, json_col).withColumn("place", F.lit("")),
        "line": line_lints(lines).withColumn("place", F.concat_ws(":", "rule", (F.col("line_no") + 1).cast("string"))),
    }
    out = None
    for name, rows in found.items():
        one = rows.select("doc_id", F.lit(name).alias("rule"), "place")
        out = one if out is None else out.unionByName(one)
    return out


def patch_top(tops: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Top-level keys (doc_id, key, value) after removing some (doc_id, key, full or bare) and adding or replacing others."""
    bare = lambda c: F.split(c, "@")[0]
    gone = removed.select("doc_id", F.col("key").alias("name"))
    left = tops.withColumn("name", bare("key")).join(gone, ["doc_id", "name"], "left_anti").drop("name")
    left = left.join(removed.select("doc_id", "key"), ["doc_id", "key"], "left_anti").join(added.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    return left.unionByName(added.select(*left.columns))


def patch_set(props: DataFrame, changes: DataFrame) -> DataFrame:
    """props with the changes' values in place of, or added to, theirs. Both: doc_id, path, key, value."""
    return props.join(changes.select("doc_id", "path", "key"), ["doc_id", "path", "key"], "left_anti").unionByName(changes)


def patch_remove(props: DataFrame, keys: DataFrame) -> DataFrame:
    return props.join(keys, ["doc_id", "path", "key"], "left_anti")


def patch_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values where there are any, else the old ones; children stay."""
    both = old.join(new.withColumnRenamed("value", "new_value"), ["doc_id", "path", "key"], "full_outer")
    return both.select("doc_id", "path", "key", F.coalesce("new_value", "value").alias("value"))


def patch_add(children: DataFrame, added: DataFrame) -> DataFrame:
    """children (parent, key, ord) with the added ones (parent, key, after) behind the child named, or at the end."""
    anchor = added.join(children.select("parent", F.col("key").alias("after"), "ord"), ["parent", "after"], "left")
    last = children.groupBy("parent").agg(F.max("ord").alias("last"))
    placed = anchor.join(last, "parent", "left").select("parent", "key", (F.coalesce("ord", "last", F.lit(-1)) + 0.5).alias("ord"))
    both = children.select("parent", "key", F.col("ord").cast("double").alias("ord")).unionByName(placed)
    return both.select("parent", "key", (F.row_number().over(Window.partitionBy("parent").orderBy("ord", "key")) - 1).cast("long").alias("ord"))


def patch_delete(children: DataFrame, gone: DataFrame) -> DataFrame:
    left = children.join(gone, ["parent", "key"], "left_anti")
    return left.select("parent", "key", (F.row_number().over(Window.partitionBy("parent").orderBy("ord", "key")) - 1).cast("long").alias("ord"))


class PatchError(ValueError):
    """A patch that cannot be applied; nothing of its batch is."""

    def __init__(self, index: int, why: str):
        super().__init__(f"patch {index}: {why}")
        self.index = index


def apply_patches(root: dict, patches: list[dict]) -> dict:
    """A copy of one interface tree with the patches applied in order; the first that fails raises and nothing is applied.

    Operations: set_prop, remove_prop, add_ctrl, remove_ctrl, replace_ctrl, merge_ctrl, add_top, remove_top. A driver-side
    edit of one document; use it inside mapInPandas for many.
    """
    import copy

    tree = copy.deepcopy(root)
    bare = lambda k: k.split("@")[0]

    def find(index: int, path: str) -> tuple[dict, str]:
        """The object that holds the control, and the control's full key."""
        names = [p for p in path.split("/") if p]
        holder, key = tree, next((k for k in tree if names and bare(k) == bare(names[0])), None)
        for name in names[1:]:
            if key is None:
                break
            entries = [(e, k) for e in holder[key].get("controls", []) for k in e if bare(k) == bare(name)]
            holder, key = entries[0] if entries else (holder, None)
        if key is None:
            raise PatchError(index, f"no control at {path!r}")
        return holder, key

    for index, p in enumerate(patches):
        op = p.get("op")
        if op == "add_top":
            tree[p["key"]] = p.get("value", {})
        elif op == "remove_top":
            found = [k for k in tree if k == p.get("key") or bare(k) == p.get("key")]
            if not found:
                raise PatchError(index, "no such key")
            del tree[found[0]]
        elif op in ("set_prop", "remove_prop"):
            holder, key = find(index, p.get("path", ""))
            if op == "set_prop":
                holder[key].update(p["props"] if "props" in p else {p["key"]: p["value"]})
            else:
                for k in p.get("keys", [p.get("key")]):
                    holder[key].pop(k, None)
        elif op in ("add_ctrl", "remove_ctrl"):
            holder, key = find(index, p.get("path", ""))
            children = holder[key].setdefault("controls", [])
            where = lambda name: next((i for i, e in enumerate(children) if any(bare(k) == bare(name) for k in e)), None)
            if op == "add_ctrl":
                at = where(p["after"]) if "after" in p else where(p["before"]) if "before" in p else None
                at = (0 if "before" in p else len(children)) if at is None else at + ("after" in p)
                children.insert(at, {p["key"]: p.get("value", {})})
            else:
                at = where(p.get("key", ""))
                if at is None:
                    raise PatchError(index, "no such child")
                del children[at]
        elif op in ("replace_ctrl", "merge_ctrl"):
            holder, key = find(index, p.get("path", ""))
            value = p.get("value", {})
            if op == "merge_ctrl":
                value = holder[key] | {k: v for k, v in value.items() if k != "controls"}
            new = p.get("new_key", key)
            items = [(new if k == key else k, value if k == key else v) for k, v in holder.items()]
            holder.clear()
            holder.update(items)
        else:
            raise PatchError(index, f"unknown operation {op!r}")
    return tree


#: The template types, and the controls of the generated screen in order.
TEMPLATES = {
    "screen_basic": ["title", "close_button"],
    "screen_list": ["title", "scroll_view", "list_item"],
    "screen_grid": ["title", "grid", "grid_item"],
    "screen_form": ["title", "edit_box", "toggle", "submit_button"],
    "screen_tabbed": ["title", "tab_bar", "tab_page"],
    "hud_overlay": ["overlay_label"],
    "widget_button": ["button"],
    "widget_progress": ["progress_bar"],
}


def generate_ui(template: str, namespace: str, mod: str) -> tuple[str, str, str]:
    """(interface JSON, Python stub, definitions entry) of a screen from a template."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}")
    kind = {"title": "label", "overlay_label": "label", "scroll_view": "scroll_view", "grid": "grid", "edit_box": "edit_box", "toggle": "toggle"}
    name = "".join(p[:1].upper() + p[1:] for p in mod.replace("-", "_").replace(" ", "_").split("_"))
    controls = [{c: {"type": kind.get(c, "button" if "button" in c else "panel"), "size": [100, 20]}} for c in TEMPLATES[template]]
    ui = {"namespace": namespace, f"{template}": {"type": "screen" if template.startswith("screen") else "panel", "controls": controls}}
    stub = f"class {name}Screen(object):\n    UI = '{namespace}.{template}'\n"
    return json.dumps(ui, indent=2, sort_keys=True), stub, json.dumps([f"ui/{namespace}.json"])
