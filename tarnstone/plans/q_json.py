"""Queries over JSON interface trees, made from regions, nations and suppliers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.operators import jsontree as J
from tarnstone.plans.base import query

KIND = "CASE WHEN s_suppkey % 7 = 0 THEN 'lable' WHEN s_suppkey % 3 = 0 THEN 'image' ELSE 'label' END"
KEY = "'i' || CAST(s_suppkey % 6 AS VARCHAR(9))"
BASE = "CASE s_suppkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'ns.item' WHEN 2 THEN 'shared' ELSE '' END"


def documents(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """One tree a region: a top panel of nations, each a stack of its suppliers, and a shared control."""
    key, base = F.concat(F.lit("i"), (F.col("s_suppkey") % 6).cast("string")), F.expr("CASE s_suppkey % 4 WHEN 0 THEN '@missing' WHEN 1 THEN '@ns.item' WHEN 2 THEN '@shared' ELSE '' END")
    body = F.concat(
        F.lit('{"type":"'), F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'lable' WHEN s_suppkey % 3 = 0 THEN 'image' ELSE 'label' END"), F.lit('","layer":'), (F.col("s_suppkey") % 5).cast("string"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN ',\"size\":[7]' ELSE concat(',\"size\":[', s_suppkey + 60, ',20]') END"),
        F.expr("CASE WHEN s_suppkey % 3 = 1 THEN ',\"anchor_from\":\"center\"' ELSE '' END"), F.expr("CASE WHEN s_suppkey % 6 = 1 THEN ',\"anchor_to\":\"center\"' ELSE '' END"),
        F.lit(',"text":"'), F.col("s_name"), F.lit('"}'),
    )
    leaf = F.concat(F.lit('{"'), key, base, F.lit('":'), body, F.lit("}"))
    leaves = supplier.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("s_suppkey", leaf.alias("j"))))["j"], ",").alias("leaves"))
    n = nation.join(leaves, nation.n_nationkey == leaves.s_nationkey, "left")
    item = F.concat(F.lit('{"'), F.col("n_name"), F.lit('@shared":{"type":"stack_panel","layer":'), F.col("n_nationkey").cast("string"), F.lit(',"controls":['), F.coalesce("leaves", F.lit("")), F.lit("]}}"))
    items = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n_nationkey", item.alias("j"))))["j"], ",").alias("items"))
    spaced = F.expr("CASE WHEN r_regionkey % 2 = 0 THEN '\"namespace\":\"ns\",' ELSE '' END")
    r = region.join(items, region.r_regionkey == items.n_regionkey, "left")
    return r.select(
        F.col("r_regionkey").cast("long").alias("doc_id"),
        F.concat(F.lit("// a tree\n{"), spaced, F.lit('"shared":{"type":"panel"},"'), F.col("r_name"), F.lit('@base.screen":{"type":"panel","size":[200,50],"controls":['), F.coalesce("items", F.lit("")), F.lit("]}}")).alias("json"),
    )


# The same nodes, straight from the tables.
NODES = f"""nodes AS (
SELECT CAST(r_regionkey AS BIGINT) AS doc_id, r_name AS path, CAST(NULL AS VARCHAR) AS parent, r_name AS bare, 'base.screen' AS base, 0 AS depth, 'panel' AS type, NULL AS k FROM region
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'shared', NULL, 'shared', NULL, 0, 'panel', NULL FROM region
UNION ALL SELECT CAST(n_regionkey AS BIGINT), r_name || '/' || n_name, r_name, n_name, 'shared', 1, 'stack_panel', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(n_regionkey AS BIGINT), r_name || '/' || n_name || '/' || {KEY}, r_name || '/' || n_name, {KEY}, nullif({BASE}, ''), 2, {KIND}, s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LEAF = f"leaf AS (SELECT n.*, s.* FROM nodes n JOIN supplier s ON n.k = s.s_suppkey)"
ON = ("region", "nation", "supplier")


def walked(*tables):
    return J.walk(documents(*tables))


@query("json_tree_walk", f"WITH {NODES} SELECT doc_id, path, CAST(depth AS BIGINT) AS depth, type FROM nodes", *ON)
def _(*t):
    return walked(*t).select("doc_id", "path", F.col("depth").cast("long").alias("depth"), "type")


@query("json_top_keys", f"WITH {NODES} SELECT doc_id, bare AS key, type FROM nodes WHERE depth = 0", *ON)
def _(*t):
    return walked(*t).filter("depth = 0").select("doc_id", F.col("bare").alias("key"), "type")


@query("json_path_lookup", f"WITH {NODES} SELECT doc_id, path, type FROM nodes WHERE path = 'shared'", *ON)
def _(*t):
    return J.lookup(walked(*t), "/shared@x/").select("doc_id", "path", "type")


PROPS = f"""props AS (
SELECT doc_id, path, 'type' AS key, type AS value FROM nodes
UNION ALL SELECT doc_id, path, 'size', '[200,50]' FROM nodes WHERE depth = 0 AND bare <> 'shared'
UNION ALL SELECT doc_id, n.path, 'layer', CAST(n_nationkey AS VARCHAR) FROM nodes n JOIN nation ON n.bare = n_name WHERE depth = 1
UNION ALL SELECT doc_id, path, 'layer', CAST(s_suppkey % 5 AS VARCHAR) FROM leaf
UNION ALL SELECT doc_id, path, 'size', CASE WHEN s_suppkey % 5 = 0 THEN '[7]' ELSE '[' || (s_suppkey + 60) || ',20]' END FROM leaf
UNION ALL SELECT doc_id, path, 'anchor_from', 'center' FROM leaf WHERE s_suppkey % 3 = 1
UNION ALL SELECT doc_id, path, 'anchor_to', 'center' FROM leaf WHERE s_suppkey % 6 = 1
UNION ALL SELECT doc_id, path, 'text', s_name FROM leaf)"""


@query("json_node_props", f"WITH {NODES}, {LEAF}, {PROPS} SELECT doc_id, path, key, value FROM props", *ON)
def _(*t):
    return J.properties(walked(*t)).select("doc_id", "path", "key", "value")


@query("json_tree_search", f"WITH {NODES}, {LEAF}, {PROPS} SELECT DISTINCT doc_id, path FROM (SELECT doc_id, path FROM nodes WHERE regexp_matches(path, '(?i)i3|image') UNION ALL SELECT doc_id, path FROM props WHERE regexp_matches(value, '(?i)i3|image'))", *ON)
def _(*t):
    nodes = walked(*t)
    return J.search_tree(nodes, J.properties(nodes), "i3|image")


@query("json_content_search", f"WITH {NODES}, {LEAF}, {PROPS} SELECT doc_id, path, key, value FROM props WHERE regexp_matches(value, '(?i)lable') OR regexp_matches(key, '(?i)lable') UNION ALL SELECT doc_id, path, '', bare || coalesce('@' || base, '') FROM nodes WHERE regexp_matches(bare || coalesce('@' || base, ''), '(?i)lable')", *ON)
def _(*t):
    nodes = walked(*t)
    return J.search_content(nodes, J.properties(nodes), "lable")


@query("tree_stats", f"WITH {NODES} SELECT doc_id, count(*) AS controls, CAST(max(depth) AS BIGINT) AS max_depth, CAST(count(*) FILTER (regexp_matches(bare, '^i')) AS BIGINT) AS hits FROM nodes GROUP BY doc_id", *ON)
def _(*t):
    return J.tree_stats(walked(*t), "^i")


@query("lint_duplicate_key", f"WITH {NODES} SELECT doc_id, parent, bare, count(*) - 1 AS surplus FROM nodes WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1", *ON)
def _(*t):
    return J.duplicate_keys(walked(*t))


@query("lint_unknown_type", f"WITH {NODES} SELECT doc_id, path, type FROM nodes WHERE type = 'lable'", *ON)
def _(*t):
    return J.unknown_types(walked(*t))


@query("lint_size", f"WITH {NODES}, {LEAF} SELECT doc_id, path, CASE WHEN s_suppkey % 5 = 0 THEN 'warning' ELSE 'suggestion' END AS severity FROM leaf WHERE s_suppkey % 5 = 0 OR s_suppkey + 60 > 100 UNION ALL SELECT doc_id, path, 'suggestion' FROM nodes WHERE depth = 0 AND bare <> 'shared'", *ON)
def _(*t):
    return J.bad_sizes(walked(*t))


@query("lint_pair", f"WITH {NODES}, {LEAF} SELECT doc_id, path FROM leaf WHERE (s_suppkey % 3 = 1) <> (s_suppkey % 6 = 1)", *ON)
def _(*t):
    return J.half_anchored(walked(*t))


@query("lint_layers", f"WITH {NODES}, {LEAF} SELECT doc_id, parent, CAST(min(CASE WHEN type = 'label' THEN s_suppkey % 5 END) AS BIGINT) AS label, CAST(max(CASE WHEN type = 'image' THEN s_suppkey % 5 END) AS BIGINT) AS image FROM leaf GROUP BY doc_id, parent HAVING label <= image", *ON)
def _(*t):
    return J.hidden_labels(walked(*t))


@query("lint_stack_child", f"WITH {NODES}, {LEAF} SELECT doc_id, path FROM leaf WHERE s_suppkey % 3 = 1", *ON)
def _(*t):
    return J.anchored_stack_children(walked(*t))


@query("lint_dangling_ref", f"WITH {NODES} SELECT doc_id, path, base FROM nodes WHERE base = 'missing'", *ON)
def _(*t):
    return J.dangling_references(walked(*t))


@query("lint_missing_key", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id FROM region WHERE r_regionkey % 2 <> 0", *ON)
def _(*t):
    return J.missing_namespace(documents(*t))


@query("lint_lines", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'binding' ELSE 'spacing' END AS rule FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 4 <> 0", "supplier")
def _(supplier):
    line = F.expr("CASE s_suppkey % 3 WHEN 0 THEN '\"binding_name\": \"name\"' WHEN 1 THEN '\"size\": [\"100%-3px\", 5]' ELSE '\"binding_name\": \"#name\"' END")
    lines = supplier.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 4 == 0, "  // ").otherwise(""), line).alias("line"))
    return J.line_lints(lines).select("s_suppkey", "rule")


@query("diagnose", f"""WITH {NODES}, {LEAF} SELECT rule, count(*) AS n FROM (
SELECT 'duplicate_key' AS rule FROM (SELECT doc_id, parent, bare FROM nodes WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'unknown_type' FROM nodes WHERE type = 'lable' UNION ALL SELECT 'anchors' FROM leaf WHERE (s_suppkey % 3 = 1) <> (s_suppkey % 6 = 1)
UNION ALL SELECT 'reference' FROM nodes WHERE base = 'missing'
UNION ALL SELECT 'size' FROM leaf WHERE s_suppkey % 5 = 0 OR s_suppkey + 60 > 100 UNION ALL SELECT 'size' FROM nodes WHERE depth = 0 AND bare <> 'shared'
UNION ALL SELECT 'layers' FROM leaf GROUP BY doc_id, parent HAVING min(CASE WHEN type = 'label' THEN s_suppkey % 5 END) <= max(CASE WHEN type = 'image' THEN s_suppkey % 5 END)
UNION ALL SELECT 'stack_child' FROM leaf WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'namespace' FROM region WHERE r_regionkey % 2 <> 0
UNION ALL SELECT 'line' FROM region WHERE r_regionkey = 3) GROUP BY rule""", *ON)
def _(*t):
    faulty = F.when(F.col("doc_id") == 3, F.concat("json", F.lit('\n// "binding_name": "x"\n'), F.lit('/* kept out of the tree:\n "binding_name": "name" */'))).otherwise(F.col("json"))
    return J.diagnose(documents(*t).withColumn("json", faulty)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Row-form patches on a property table made from parts.
P_SQL = "p AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS doc_id, 'c' || p_partkey AS path, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT CAST(p_partkey % 50 AS BIGINT), 'c' || p_partkey, 'brand', p_brand FROM part)"


def props(part: DataFrame) -> DataFrame:
    at = [(F.col("p_partkey") % 50).cast("long").alias("doc_id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("path")]
    return part.select(*at, F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")).unionByName(part.select(*at, F.lit("brand").alias("key"), F.col("p_brand").alias("value")))


@query("patch_set", f"WITH {P_SQL} SELECT doc_id, path, key, CASE WHEN key = 'size' AND doc_id < 5 THEN '0' ELSE value END AS value FROM p", "part")
def _(part):
    p = props(part)
    return J.patch_set(p, p.filter("key = 'size' AND doc_id < 5").withColumn("value", F.lit("0")))


@query("patch_remove", f"WITH {P_SQL} SELECT * FROM p WHERE NOT (key = 'brand' AND doc_id % 2 = 0)", "part")
def _(part):
    p = props(part)
    return J.patch_remove(p, p.filter("key = 'brand' AND doc_id % 2 = 0").select("doc_id", "path", "key"))


@query("patch_merge", f"WITH {P_SQL} SELECT doc_id, path, key, CASE WHEN key = 'size' AND doc_id < 9 THEN 'merged' ELSE value END AS value FROM p UNION ALL SELECT DISTINCT doc_id, path, 'layer', '1' FROM p WHERE doc_id < 9", "part")
def _(part):
    p = props(part)
    some = p.filter("doc_id < 9 AND key = 'size'").select("doc_id", "path")
    return J.patch_merge(p, some.select("doc_id", "path", F.lit("size").alias("key"), F.lit("merged").alias("value")).unionByName(some.select("doc_id", "path", F.lit("layer").alias("key"), F.lit("1").alias("value"))))


@query("patch_top", """SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name || '@base' AS key, CASE WHEN n_nationkey = 7 THEN 'new' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation WHERE n_nationkey > 3
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'extra', 'new' FROM region""", "region", "nation")
def _(region, nation):
    at = [F.col("n_regionkey").cast("long").alias("doc_id"), F.concat("n_name", F.lit("@base")).alias("key")]
    tops = nation.select(*at, F.col("n_nationkey").cast("string").alias("value"))
    added = nation.filter("n_nationkey = 7").select(*at, F.lit("new").alias("value")).unionByName(region.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("extra").alias("key"), F.lit("new").alias("value")))
    removed = nation.filter("n_nationkey < 3").select("n_regionkey", F.col("n_name").alias("key")).unionByName(nation.filter("n_nationkey = 3").select("n_regionkey", F.concat("n_name", F.lit("@base")).alias("key")))
    return J.patch_top(tops, added, removed.withColumnRenamed("n_regionkey", "doc_id"))


C_SQL = "c AS (SELECT CAST(n_regionkey AS BIGINT) AS parent, n_name AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS ord FROM nation)"


def children(nation: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return nation.select(F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("key"), at.cast("long").alias("ord"))


@query("patch_add", f"WITH {C_SQL} SELECT parent, key, CASE WHEN ord > 1 THEN ord + 1 ELSE ord END AS ord FROM c UNION ALL SELECT parent, 'NEW', 2 FROM c WHERE ord = 1", "nation")
def _(nation):
    c = children(nation)
    return J.patch_add(c, c.filter("ord = 1").select("parent", F.lit("NEW").alias("key"), F.col("key").alias("after")))


@query("patch_delete", f"WITH {C_SQL} SELECT parent, key, CASE WHEN ord > 2 THEN ord - 1 ELSE ord END AS ord FROM c WHERE ord <> 2", "nation")
def _(nation):
    c = children(nation)
    return J.patch_delete(c, c.filter("ord = 2").select("parent", "key"))


@query("patch_batch", None, *ON)
def _(region, nation, supplier):
    """Each tree rewritten by a batch of patches, inside mapInPandas; a failing batch leaves its tree as it was."""
    batch = [{"op": "set_prop", "path": "shared", "key": "visible", "value": False}, {"op": "add_top", "key": "extra", "value": {"type": "label"}}, {"op": "add_ctrl", "path": "shared", "key": "child", "value": {"type": "image"}}]

    def patched(parts):
        import json

        for pdf in parts:
            for i, text in enumerate(pdf["json"]):
                tree = json.loads(text.split("\n", 1)[1])
                pdf.loc[pdf.index[i], "json"] = json.dumps(J.apply_patches(tree, batch), sort_keys=True)
            yield pdf

    return documents(region, nation, supplier).mapInPandas(patched, "doc_id long, json string")


@query("template_render", None, "nation")
def _(nation):
    """Every template's screen for each nation, whose name is the namespace."""

    def rendered(parts):
        for pdf in parts:
            rows = [(n, t, *J.generate_ui(t, n.lower().replace(" ", "_"), n.lower())) for n in pdf["n_name"] for t in sorted(J.TEMPLATES)]
            yield pd.DataFrame(rows, columns=["nation", "template", "ui", "code", "defs"])

    return nation.select("n_name").mapInPandas(rendered, "nation string, template string, ui string, code string, defs string")
