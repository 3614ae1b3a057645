"""The stored index: blocks, pruned searches, refreshes, torn writes, and Chinese contents against plain BM25."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnstone.functions import segment as G
from tarnstone.operators.knowledge import ENGLISH, FRAGMENT, Knowledge, Tokenizer, chinese, posting_blocks
from tarnstone.plans.q_segment import model
from tarnstone.service import SearchService

#: The keywords of the load test.
KEYWORDS = [
    "玩家血量", "实体速度", "方块破坏", "物品栏", "音效播放",
    "粒子效果", "玩家传送", "世界坐标", "附魔", "经验值",
    "事件监听", "组件系统", "UI界面", "摄像机", "天气",
    "方块放置", "实体生成", "伤害计算", "物品栏操作", "背包",
]
PARTS = ["玩家", "血量", "实体", "速度", "方块", "破坏", "物品", "物品栏", "音效", "播放", "粒子", "效果", "传送", "世界", "坐标", "附魔", "经验", "经验值", "事件", "监听", "组件", "系统", "界面", "摄像机", "天气", "放置", "生成", "伤害", "计算", "操作", "背包"]
SCHEMA = "doc_id long, file string, category string, line_start long, line_end long, content string"


def segmenter():
    return G.Segmenter(G.Lexicon.parse([f"{w} {100 + 7 * i} n" for i, w in enumerate(PARTS)]), model())


def bm25(tokens, query):
    """tokens: doc -> list -> (doc, score), best first."""
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    score = Counter()
    for term in dict.fromkeys(query):
        counts = {d: t.count(term) for d, t in tokens.items()}
        df = sum(c > 0 for c in counts.values())
        for d, tf in counts.items():
            if tf:
                score[d] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[d]) / avg))
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


def same(rows, want):
    """All hits, or where want is cut the best ones: the scores agree, and so do the documents but for ties at the cut."""
    got = {r.doc_id: r.score for r in rows}
    assert len(got) == len(rows) == len(want) and sorted(round(x, 9) for x in got.values()) == sorted(round(x, 9) for _, x in want)
    least = min(got.values(), default=0)
    assert all(d in got and math.isclose(got[d], x, rel_tol=1e-9) for d, x in want if x > least + 1e-9)


def build(spark, folder, rows, block=8, **k):
    """rows: FRAGMENT rows; a file's time is its number of rows."""
    df = spark.createDataFrame(rows, SCHEMA)
    files = df.groupBy("file").agg(F.count(F.lit(1)).alias("length"), F.sum(F.length("content")).alias("modified")).withColumnRenamed("file", "path")
    index = Knowledge(spark, f"file://{folder}", block=block, **k)
    asked = []

    def read(paths):
        asked.extend(r.path for r in paths.collect())
        return df.join(paths.withColumnRenamed("path", "file"), "file", "left_semi").select(*FRAGMENT)

    return index, index.refresh(files, read), sorted(asked)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, f"f{i % 7}", "A" if i % 3 else "B", 1, 1, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(n)]


def test_blocks_are_bounded_and_whole(spark):
    rows = [("A", f"t{k}", i, 1 + i % 3, 10, 0.5 + i / 10**6) for k in range(3) for i in range(k * 500 + 1)]
    df = spark.createDataFrame(rows, "category string, term string, doc_id long, tf int, dl int, impact double")
    got = posting_blocks(df.repartition(5), 64).collect()
    assert all(len(r.docs) == len(r.tfs) == len(r.dls) == r.n <= 64 and r.docs == sorted(r.docs) and (r["first"], r["last"]) == (r.docs[0], r.docs[-1]) for r in got)
    assert all(r.impact == max(0.5 + d / 10**6 for d in r.docs) for r in got)
    listed = sorted((r.term, d, t) for r in got for d, t in zip(r.docs, r.tfs, strict=True))
    assert listed == sorted((t, d, f) for _, t, d, f, _, _ in rows)
    spans = sorted((r.term, r["first"], r["last"]) for r in got)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_searches_are_those_of_plain_bm25(spark, tmp_path):
    rows = corpus(1)
    index, moved, _ = build(spark, tmp_path, rows)
    assert moved == {"added": 7, "changed": 0, "gone": 0}
    for category in "AB":
        tokens = {r[0]: r[5].split() for r in rows if r[2] == category}
        for query in (["w0", "w39"], ["w30"], ["w1", "w2", "w38", "none"]):
            want = bm25(tokens, query)
            same(index.search(category, query).collect(), want)
            same(index.search(category, query, 3).collect(), want[:3])
    assert index.search("A", ["none"], 3).count() == 0 and index.search("none", ["w0"], 3).count() == 0 and index.search("A", [], 3).count() == 0


def test_a_search_reads_few_blocks(spark, tmp_path):
    # Short documents with the rare word come first in their lists; the rest cannot reach the best.
    rows = [(i, "f", "A", 1, 1, "common " * (1 if i % 50 else 9) + "filler " * (i % 40) + ("rare" if i in (3, 700) else "")) for i in range(1000)]
    index, _, _ = build(spark, tmp_path, rows, block=16)
    whole, read = index.blocks_read("A", ["common"]).count(), index.blocks_read("A", ["common"], 2).count()
    assert whole >= 63 and read <= 8
    same(index.search("A", ["common"], 2).collect(), bm25({r[0]: r[5].split() for r in rows}, ["common"])[:2])
    plan = index.blocks_read("A", ["common"], 2)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PushedFilters") :]
    assert "IsNotNull(impact)" in scan and "EqualTo(term,commo" in scan
    same(index.search("A", ["common", "rare"], 1).collect(), bm25({r[0]: r[5].split() for r in rows}, ["common", "rare"])[:1])


def test_only_changed_files_are_read_again(spark, tmp_path):
    rows = corpus(2, 60)
    build(spark, tmp_path, rows)
    index, moved, asked = build(spark, tmp_path, rows)
    assert moved == {"added": 0, "changed": 0, "gone": 0} and asked == []
    new = [(d, f, c, a, b, t + " w0 more" if f == "f2" else t) for d, f, c, a, b, t in rows if f != "f5"] + [(999, "g", "B", 1, 1, "w0 fresh")]
    index, moved, asked = build(spark, tmp_path, new)
    assert moved == {"added": 1, "changed": 1, "gone": 1} and asked == ["f2", "g"]
    for category in "AB":
        same(index.search(category, ["w0", "fresh", "more"]).collect(), bm25({r[0]: r[5].split() for r in new if r[2] == category}, ["w0", "fresh", "more"]))
    index.clear()
    assert len([x for x in os.listdir(tmp_path) if x.startswith("generation")]) == 1
    same(index.search("B", ["fresh"]).collect(), bm25({r[0]: r[5].split() for r in new if r[2] == "B"}, ["fresh"]))


def test_versions_setups_and_torn_writes(spark, tmp_path, monkeypatch):
    from tarnstone.operators import knowledge

    rows = corpus(3, 20)
    index, _, asked = build(spark, tmp_path, rows)
    before = index.manifest().generation
    # A generation without a manifest is not read, nor is half a manifest.
    (tmp_path / "generation-torn/docs").mkdir(parents=True)
    (tmp_path / "manifest/part-torn.json").write_text('{"epoch": 99, "version": 1, "gener')
    assert index.manifest().generation == before
    index, moved, asked = build(spark, tmp_path, rows)
    assert asked == []
    # A manifest whose tables are gone does not count.
    (tmp_path / "manifest/part-lost.json").write_text('{"epoch": 50, "version": 1, "setup": "%s", "fingerprint": "x", "generation": "generation-lost"}\n' % index._setup())
    assert index.usable() is None
    index, moved, asked = build(spark, tmp_path, rows)
    assert len(asked) == 7 and index.manifest().epoch == 51
    monkeypatch.setattr(knowledge, "VERSION", 2)
    assert index.usable() is None
    with pytest.raises(ValueError):
        index.search("A", ["w0"])
    index, moved, asked = build(spark, tmp_path, rows)
    assert len(asked) == 7 and index.manifest().version == 2
    # Another tokeniser makes another index.
    other = Tokenizer("english-other", ENGLISH.tokens)
    assert len(build(spark, tmp_path, rows, other=other)[2]) == 7
    assert build(spark, tmp_path, [], other=other)[1] == {"added": 0, "changed": 0, "gone": 7}


def test_two_tokenisers_share_a_table(spark, tmp_path):
    rows = [(1, "a", "CN", 1, 1, "玩家血量UI界面"), (2, "a", "CN", 1, 1, None), (3, "a", "EN", 1, 1, "UI 界面 Panel"), (4, "b", None, 1, 1, "panel")]
    index, _, _ = build(spark, tmp_path, rows, tokenizers={"CN": chinese(spark, segmenter(), frozenset({"血量"}))})
    terms = {(r.category, r.term) for r in index.table("terms").collect()}
    assert terms == {("CN", "玩家"), ("CN", "UI"), ("CN", "界面"), ("EN", "ui"), ("EN", "panel"), (None, "panel")}
    same(index.search("CN", ["界面"]).collect(), bm25({1: ["玩家", "UI", "界面"], 2: []}, ["界面"]))


@pytest.fixture
def tree(tmp_path):
    rnd = random.Random(7)
    for k in range(8):
        place = tmp_path / ["docs/接口", "docs/事件", "NeteaseGuide", "BedrockWiki"][k % 4]
        place.mkdir(parents=True, exist_ok=True)
        body = "".join(f"## 第{i}节\n" + "".join(rnd.choice([*KEYWORDS, *PARTS, "，", "api_call", "的"]) for _ in range(30)) + "\n" for i in range(5))
        (place / f"{k}.md").write_text(body)
    return tmp_path


def test_the_keywords_rank_as_by_plain_bm25(spark, tree):
    s = segmenter()
    service = SearchService(spark, str(tree), s, frozenset({"的"}))
    docs = {}
    for r in service.fragments.collect():
        docs.setdefault(r.category, {})[r.doc_id] = s.tokens(r.content, frozenset({"的"}))
    searches = {"API": service.search_api, "Event": service.search_event, "NeteaseGuide": service.search_netease_guide}
    found = 0
    for i, keyword in enumerate(KEYWORDS):
        category = list(searches)[i % 3]
        got = searches[category](keyword, 4).collect()
        want = bm25(docs[category], s.tokens(keyword))[:4]
        assert sorted((r.doc_id, round(r.score, 9)) for r in got) == sorted((d, round(x, 9)) for d, x in want), keyword
        found += bool(got)
    assert found == len(KEYWORDS)
    assert service.search_all("玩家血量", 3).count() == 3
    # Latin words keep their case in Chinese contents; an English query is lower-cased.
    assert service.search_api("api_call").count() == 0 or service.search_api("api").count() > 0


def test_refresh_and_subscription(spark, tree):
    index = tree.parent / f"{tree.name}-index"
    service = SearchService(spark, str(tree), index=f"file://{index}")
    watch = service.subscribe()
    assert watch.updates().count() == 0 and service.refresh() == {"added": 0, "changed": 0, "gone": 0}
    (tree / "BedrockWiki/new.md").write_text("## New\nzebra\n")
    (tree / "BedrockWiki/3.md").write_text("## Other\nokapi\n")
    (tree / "docs/接口/0.md").unlink()
    (tree / "notes.txt").write_text("not indexed")
    got = {r.uri: r.kind for r in watch.updates().collect()}
    assert got == {"file:///BedrockWiki/new.md": "added", "file:///BedrockWiki/3.md": "changed", "file:///docs/接口/0.md": "gone", "file:///notes.txt": "added"}
    assert watch.updates().count() == 0
    assert service.refresh() == {"added": 1, "changed": 1, "gone": 1}
    assert service.search_wiki("zebra").count() == 1 and service.search_wiki("okapi").count() == 1
    again = SearchService(spark, str(tree), index=f"file://{index}")
    assert again.index.manifest().epoch == 2 and again.search_wiki("okapi").first().content == "## Other\nokapi\n"


def test_saved_terms_are_counted_from_saved_postings(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnstone.operators import search as S

    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        cuts.add(1)
        return text

    docs = spark.createDataFrame([(1, "The cat, the Dog"), (2, "a dog"), (3, None), (4, "x_1 X_1 É İ \u212a")], "doc_id long, text string")
    S.build_index(docs.withColumn("text", said("text"))).save(str(tmp_path / "i"))
    assert cuts.value <= 16  # postings, with the sample for their ranges, and lengths; terms and statistics need no text
    kept, whole = S.Index.load(spark, str(tmp_path / "i")), S.build_index(docs)
    for name in ("postings", "doc_stats", "terms", "corpus"):
        assert sorted(map(tuple, getattr(kept, name).select(*getattr(whole, name).columns).collect())) == sorted(map(tuple, getattr(whole, name).collect()))
    assert {r.term for r in kept.terms.collect()} == {"the", "cat", "dog", "a", "x_1"}


def test_keywords_of_rare_and_common_terms(spark, sf):
    from tarnstone.operators import search as S

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda common: sorted(map(tuple, S.tfidf_keywords(docs, 5, common).collect()))
    assert rows(50) == rows(S.COMMON) and len(rows(50)) > 500


def test_terms_travel_in_runs_and_come_back_in_order(spark):
    from tarnstone.operators.knowledge import counted, document_blocks

    rnd = random.Random(5)
    rows = [(rnd.choice(["A", "B", None]), d * 7 - 900, rnd.choices(["a", "é", "", "\n", "x\x1fy", "common", f"w{d % 50}"], k=rnd.randint(0, 12))) for d in range(700)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "category string, doc_id long, tokens array<string>").repartition(6)
    said = docs.select("category", "doc_id", counted(F.col("tokens")).alias("said")).select("category", "doc_id", "said.*", F.lit(5.0).alias("avg_dl"))
    want = sorted((c or "", t, d, n, len(x)) for c, d, x in rows for t, n in Counter(x).items())
    for bounds in ([], [-900, 0, 1000, 1007, 9999]):
        got = document_blocks(said, bounds, 16).collect()
        assert sorted((r.category or "", r.term, *p) for r in got for p in zip(r.docs, r.tfs, r.dls, strict=True)) == want
        assert all(len(r.docs) == r.n <= 16 and r.docs == sorted(r.docs) and (r["first"], r["last"]) == (r.docs[0], r.docs[-1]) for r in got)
        assert all(math.isclose(r.impact, max(t / (t + 1.5 * (0.25 + 0.75 * n / 5)) for t, n in zip(r.tfs, r.dls, strict=True))) for r in got)
        spans = sorted((r.category or "", r.term, r["first"], r["last"]) for r in got)
        assert all(a[:2] != b[:2] or a[3] < b[2] for a, b in zip(spans, spans[1:]))


def test_a_refresh_writes_contents_and_terms_once(spark, tmp_path, monkeypatch):
    from tarnstone.operators import knowledge

    names = []
    kept = knowledge.stored
    monkeypatch.setattr(knowledge, "stored", lambda df, name: names.append(name) or kept(df, name))
    monkeypatch.setattr(knowledge, "RANGE", 16)
    rows = corpus(4, 80)
    index, _, _ = build(spark, tmp_path, rows)
    assert set(names) == {"index-files", "index-moved"}
    assert index.table("docs").columns == [*FRAGMENT, "dl"] and len(index._bounds(index.table("docs"))) == 4
    for category in "AB":
        same(index.search(category, ["w0", "w3"]).collect(), bm25({r[0]: r[5].split() for r in rows if r[2] == category}, ["w0", "w3"]))


def test_a_saved_index_cuts_texts_once(spark, tmp_path):
    from tarnstone.operators import search as S

    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        cuts.add(1)
        return text

    # A doc_id that is told twice is one document of the postings and two lengths, as in the index that is not saved.
    docs = spark.createDataFrame([(1, "The cat, the Dog"), (2, "a dog"), (3, None), (2, "dog K x_1 X_1"), (4, "")], "doc_id long, text string")
    S.build_index(docs.withColumn("text", said("text"))).save(str(tmp_path / "i"))
    assert cuts.value == 5
    kept, whole = S.Index.load(spark, str(tmp_path / "i")), S.build_index(docs)
    for name in ("postings", "doc_stats", "terms", "corpus"):
        assert sorted(map(tuple, getattr(kept, name).select(*getattr(whole, name).columns).collect())) == sorted(map(tuple, getattr(whole, name).collect()))
