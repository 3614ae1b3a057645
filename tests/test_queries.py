"""Every registered query beside its DuckDB statement on the smallest tables, and the service on a small tree."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection

NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
#: Nothing of the kind is in the smallest tables.
EMPTY = {"lint_duplicate_key", "lint_layers"}


@pytest.fixture(scope="session")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    said = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert said in ("", "both empty" if name in EMPTY else "")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_optional():
    import pathlib

    for path in pathlib.Path(entry.__file__).parent.joinpath("tarnstone").rglob("*.py"):
        assert "llm" in path.parts or "tarnstone.llm" not in path.read_text(), path


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("knowledge")
    for path, text in {
        "BedrockWiki/a.md": "intro line\n## Render controller\nrender the controller\n# top\n### Loot\nloot table here\n",
        "BedrockWiki/b.md": "## Other\nfood and loot\n\n",
        "docs/事件/e.md": "## OnPlayerAttackEvent\nserver side\n## MobDieEvent\nmob\n",
        "docs/接口/x.md": "## SetPos\nset position\n",
        "notes/readme.md": "not indexed\n",
        "GameAssets/behavior_packs/v/snow_golem.json": '{"a": "snow"}',
        "GameAssets/resource_packs/v/snow.lang": "golem snow golem",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return str(root)


def test_service(spark, tree):
    from tarnstone.service import SearchService

    service = SearchService(spark, tree)
    rows = service.fragments.orderBy("file", "line_start").collect()
    assert [(r.file, r.line_start, r.line_end) for r in rows if r.file == "BedrockWiki/a.md"] == [("BedrockWiki/a.md", 1, 2), ("BedrockWiki/a.md", 2, 5), ("BedrockWiki/a.md", 5, 6)]
    assert {r.category for r in rows} == {"Wiki", "Event", "API"}
    assert service.search_wiki("loot table").first().content.startswith("### Loot")
    assert service.search_event("onplayer").first().score == 1000 - (len("OnPlayerAttackEvent") - len("onplayer"))
    assert service.search_all("loot render", 3).count() == 3
    assert [r.path for r in service.dispatch("assets:snow_golem").collect()][0].endswith("snow_golem.json")
    assert service.search_game_assets("snow", 2).count() == 1
    got = service.read_knowledge("BedrockWiki/b.md", 2, 9).first()
    assert (got.content, got.total_lines) == ("food and loot\n", 3)
    assert [(r.kind, r.name) for r in service.list_knowledge("BedrockWiki").collect()] == [("file", "a.md"), ("file", "b.md")]
    with pytest.raises(ValueError):
        service.read_knowledge("../x")
    # The event's name scores by the hundred, so it leads all contents.
    every = service.search_all("onplayer", 5).collect()
    assert every[0].score == 1000 - (len("OnPlayerAttackEvent") - len("onplayer")) and every[0].file == "docs/事件/e.md"
    assert [r.snippet for r in service.search_game_assets("snow golem", 0, 2).collect() if r.path.endswith("snow.lang")] == ["golem snow golem"]
    assert service.read_resource("file:///BedrockWiki/b.md").first().text.startswith("## Other") and service.resources().count() == 7
    assert service.call("search_wiki", {"keyword": "loot table", "top_k": 1}).count() == 1
    for tool, arguments in (("search_wiki", {}), ("search_wiki", {"keyword": ""}), ("search_wiki", {"keyword": "a", "other": 1}), ("none", {}), ("read_resource", {"uri": "file:///../x"})):
        with pytest.raises(ValueError):
            service.call(tool, arguments)


def test_files_written_and_loaded(spark, tmp_path):
    from tarnstone.functions.segment import Lexicon, load_weights
    from tarnstone.sources.files import write_json

    (tmp_path / "old.json").write_text("[]")
    rows = [("old.json", '{"b": 1, // said\n "a": "/* kept */"}'), ("deep/new.json", '{"a": [1, 2], "a": "last"}')]
    write_json(spark, spark.createDataFrame(rows, "path string, json string"), f"file://{tmp_path}")
    assert (tmp_path / "old.json").read_text() == '{\n  "a": "/* kept */",\n  "b": 1\n}' and (tmp_path / "deep/new.json").read_text() == '{\n  "a": "last"\n}'
    with pytest.raises(ValueError):
        write_json(spark, spark.createDataFrame([("../x.json", "{}")], "path string, json string"), f"file://{tmp_path}")
    (tmp_path / "words").write_text("the 10 d\nand 5 c\n")
    (tmp_path / "own").write_text("tarn 7 n\nstone\n")
    lexicon = Lexicon.load(spark, str(tmp_path / "words"), str(tmp_path / "own"))
    assert set(lexicon.weight) == {"the", "and", "tarn", "stone"} and lexicon.user == {"tarn", "stone"}
    (tmp_path / "idf").write_text("the 1.5\nbroken\nand 2\n")
    assert load_weights(spark, str(tmp_path / "idf")) == {"the": 1.5, "and": 2.0}


def test_trees_and_bones_beyond_the_row_limits(spark):
    from tarnstone.operators.jsontree import walk
    from tarnstone.operators.rig import descendants

    deep = '{"type": "panel"}'
    for i in range(300):
        deep = f'{{"controls": [{{"c{i}": {deep}}}]}}'
    text = f'{{"top": {deep}, "note": "no // comment, no /* comment */"}} // the end'
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        nodes = walk(spark.createDataFrame([(1, text), (2, None), (3, "{broken"), (4, '{"a": {"text": "x /* y */ z"}}')], "doc_id long, json string"))
        assert {r.doc_id: (r.n, r.d) for r in nodes.groupBy("doc_id").agg({"path": "count", "depth": "max"}).toDF("doc_id", "n", "d").collect()} == {1: (301, 300), 4: (1, 0)}
        assert nodes.filter("doc_id = 4").selectExpr("variant_get(node, '$.text', 'string') AS t").first().t == "x /* y */ z"
        bones = spark.createDataFrame([(f"b{i}", f"b{i - 1}" if i else None) for i in range(130)] + [("x", "y"), ("y", "x"), ("lost", "nowhere"), ("twig", "b5")], "bone string, parent string")
        assert {r.bone: r.depth for r in descendants(bones, "b3").collect()} == {f"b{i}": i - 3 for i in range(4, 130)} | {"twig": 3}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
