"""The search service: one object over a document tree, with the searches, listings and reads of the tool catalogue."""

from __future__ import annotations

import inspect
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions.segment import Segmenter
from tarnstone.functions.text import longest_identifier, media_type
from tarnstone.operators import search as S
from tarnstone.operators.fragments import list_dir, read_range
from tarnstone.operators.knowledge import ENGLISH, Knowledge, chinese
from tarnstone.sources import files

#: Default number of hits of a tool call, and of an asset search without one.
TOP_K, ASSETS_K = 6, 200


#: What the uris of files start with.
RESOURCE = "file:///"
#: Categories whose contents are cut by the Chinese segmenter; all others by the English rule.
CHINESE = ("API", "Event", "Enum", "QuMod", "NeteaseGuide")


def plain_words(keyword: str) -> bool:
    """English words that do not look like one exact identifier."""
    english = keyword.isascii() and re.search("[A-Za-z0-9_]", keyword)
    precise = re.fullmatch("[A-Za-z0-9_]+", keyword) and len(re.sub("[^A-Za-z]", "", keyword)) >= 12 and re.search("[A-Z]", keyword) and re.search("[a-z]", keyword)
    return bool(english and not precise)


def checked(function: Callable, arguments: dict) -> dict:
    """The arguments, if none that the function requires is missing or empty and none is unknown."""
    known = {k: p for k, p in inspect.signature(function).parameters.items()}
    missing = [k for k, p in known.items() if p.default is p.empty and arguments.get(k) in (None, "")]
    if missing:
        raise ValueError(f"missing required parameter: {', '.join(missing)}")
    unknown = [k for k in arguments if k not in known]
    if unknown:
        raise ValueError(f"unknown parameter: {', '.join(unknown)}")
    return {k: v for k, v in arguments.items() if v is not None}


class Subscription:
    """Changes of the files under a folder since the last look, by time and length."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.seen = self._listed()

    def _listed(self) -> DataFrame:
        return files.stored(files.listing(self.spark, self.root), "listing")

    def updates(self) -> DataFrame:
        """uri, kind (added, changed, gone) of what differs from the listing of the last call; this one's is kept for the next."""
        before, self.seen = self.seen, self._listed()
        return files.differences(before, self.seen).select(F.concat(F.lit(RESOURCE), "path").alias("uri"), "kind")


class SearchService:
    """Searches return DataFrames of doc_id, score, file, line_start, line_end, content, best first.

    The content of a fragment is joined only after the best rows are known. segmenter, stop: of Chinese contents and
    queries; without one, all is cut by the English rule. index: the folder of the stored index, which is brought up to the
    files when the service starts and by refresh(); without it, a new one in the shared folder.
    """

    def __init__(self, spark: SparkSession, root: str, segmenter: Segmenter | None = None, stop: frozenset[str] = frozenset(), index: str | None = None):
        self.spark, self.root = spark, root
        self.chinese = (lambda text: segmenter.tokens(text, stop)) if segmenter else None
        own = chinese(spark, segmenter, stop) if segmenter else ENGLISH
        self.index = Knowledge(spark, index or f"{files.shared_folder(spark)}/tarnstone/knowledge-{uuid.uuid4().hex}", dict.fromkeys(CHINESE, own))
        self.assets = files.assets(spark, root).cache()
        self.files = files.scan(spark, root).select("path", F.col("content").alias("text"))
        self.refresh()

    def refresh(self) -> dict[str, int]:
        """Reads what has changed since the index was written; how many files were added, changed and gone."""
        moved = self.index.refresh(files.indexed(files.listing(self.spark, self.root)), lambda paths: files.markdown_fragments(self.spark, self.root, paths))
        self.fragments = self.index.table("docs").drop("dl")
        return moved

    def subscribe(self) -> Subscription:
        return Subscription(self.spark, self.root)

    def _event(self, keyword: str, top_k: int) -> DataFrame:
        """Plain English words go against event names first; what finds none, and all else, is ranked by content."""
        ranked = self._ranked("Event", keyword, top_k, "prefer_english_fallback")
        if not plain_words(keyword):
            return ranked
        events = self.fragments.filter("category = 'Event'").withColumn("name", longest_identifier(F.col("content"))).filter("name IS NOT NULL")
        named = S.search_identifiers(events, "name", keyword, min(top_k, 8) if top_k > 0 else 8).select("doc_id", "score")
        return S.fallback(named, ranked).drop("phase")

    def _ranked(self, category: str, keyword: str, top_k: int, mode: str = "auto") -> DataFrame:
        mode = "english" if category == "Wiki" else mode
        first, second = (S.query_tokens(keyword, mode, again, self.chinese) for again in (False, True))
        scored = self.index.search(category, first, top_k)
        return scored if first == second else S.fallback(scored, self.index.search(category, second, top_k)).drop("phase")

    def _with_content(self, scored: DataFrame) -> DataFrame:
        return scored.join(self.fragments.drop("category"), "doc_id").orderBy(F.desc("score"), "file", "line_start")

    def search_api(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        return self._with_content(self._ranked("API", keyword, top_k))

    def search_enum(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        return self._with_content(self._ranked("Enum", keyword, top_k))

    def search_wiki(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        return self._with_content(self._ranked("Wiki", keyword, top_k))

    def search_qumod(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        return self._with_content(self._ranked("QuMod", keyword, top_k))

    def search_netease_guide(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        return self._with_content(self._ranked("NeteaseGuide", keyword, top_k))

    def search_event(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        return self._with_content(self._event(keyword, top_k))

    def search_all(self, keyword: str, top_k: int = TOP_K) -> DataFrame:
        """Each category's best, found by its own search, put together by raw score: an event's name beats any content."""
        each = max(3 * top_k, 30) if top_k > 0 else 60
        scored = self._event(keyword, each)
        for category in ("API", "Enum", "Wiki", "QuMod", "NeteaseGuide"):
            scored = scored.unionByName(self._ranked(category, keyword, each))
        placed = scored.join(self.fragments.select("doc_id", "file", "line_start"), "doc_id").orderBy(F.desc("score"), "file", "line_start")
        return self._with_content((placed.limit(top_k) if top_k > 0 else placed).select("doc_id", "score"))

    def search_game_assets(self, keyword: str, scope: int = 0, top_k: int = TOP_K) -> DataFrame:
        """path, score, snippet; scope 0: both packs, 1: behaviour, 2: resource, else none."""
        packs = {0: ["behavior_packs", "resource_packs"], 1: ["behavior_packs"], 2: ["resource_packs"]}.get(scope, [])
        tokens = S.query_tokens(keyword, chinese=self.chinese)
        return S.search_assets(self.assets.filter(F.col("pack").isin(*packs)), keyword, tokens, top_k if top_k > 0 else ASSETS_K, snippet=True)

    def read_knowledge(self, path: str, line_start: int = 1, line_end: int = 1 << 30) -> DataFrame:
        if ".." in path or not path:
            raise ValueError("not a path under the corpus")
        return read_range(self.files.filter(F.col("path") == path).withColumnRenamed("path", "doc_id"), line_start, min(line_end, 1 << 30))

    def list_knowledge(self, path: str = "") -> DataFrame:
        if ".." in path:
            raise ValueError("not a path under the corpus")
        return list_dir(self.files, path).orderBy("kind", "name")

    def resources(self) -> DataFrame:
        """uri, name, mime of every file."""
        return self.files.select(F.concat(F.lit(RESOURCE), "path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("name"), media_type(F.col("path")).alias("mime"))

    def resource_templates(self) -> list[dict[str, str]]:
        return [{"uriTemplate": f"{RESOURCE}{{path}}", "name": "file of the corpus"}]

    def read_resource(self, uri: str) -> DataFrame:
        """uri, mime, text of one file; none if there is no such file."""
        path = uri.removeprefix(RESOURCE)
        if not uri.startswith(RESOURCE) or ".." in path or not path:
            raise ValueError("not a resource of the corpus")
        return self.files.filter(F.col("path") == path).select(F.lit(uri).alias("uri"), media_type(F.col("path")).alias("mime"), "text")

    def call(self, tool: str, arguments: dict) -> DataFrame:
        """A tool by name, with its arguments checked: a required one that is missing, or an unknown tool, raises."""
        tools = {
            "search_api": self.search_api, "search_event": self.search_event, "search_enum": self.search_enum, "search_wiki": self.search_wiki, "search_qumod": self.search_qumod,
            "search_netease_guide": self.search_netease_guide, "search_all": self.search_all, "search_game_assets": self.search_game_assets,
            "read_knowledge": self.read_knowledge, "list_knowledge": self.list_knowledge, "read_resource": self.read_resource,
        }
        if tool not in tools:
            raise ValueError(f"unknown tool {tool!r}")
        return tools[tool](**checked(tools[tool], arguments))

    def doc_count(self) -> int:
        return self.fragments.count()

    def dispatch(self, query: str, top_k: int = TOP_K) -> DataFrame:
        """A prefix names the search: api: event: enum: all: wiki: qumod: guide: assets: assets_bp: assets_rp:; default all."""
        kind, _, rest = query.partition(":")
        one = {"api": self.search_api, "event": self.search_event, "enum": self.search_enum, "wiki": self.search_wiki, "qumod": self.search_qumod, "guide": self.search_netease_guide, "all": self.search_all}
        scope = {"assets": 0, "assets_bp": 1, "assets_rp": 2}
        if kind in scope:
            return self.search_game_assets(rest.strip(), scope[kind], top_k)
        return one[kind](rest.strip(), top_k) if kind in one and rest else self.search_all(query, top_k)
