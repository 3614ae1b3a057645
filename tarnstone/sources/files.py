"""File sources and sinks: document trees, asset packs, JSON with comments, word lists, images and pixel files."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions.text import INDEXED, classify_path
from tarnstone.operators.fragments import fragments

#: What the corpus cleaner keeps.
KEEP_EXTENSIONS = ("json", "fragment", "vertex", "material", "h", "lang")
KEEP_NAMES = ("manifest.json", "contents.json")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, a session on one machine gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tarnstone-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/tarnstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """(file system, path) of a path on any store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern of the store matches, in order."""
    store, place = _place(spark, pattern)
    return sorted(x.getPath().toString() for x in store.globStatus(place) or [])


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it; nothing if it is not there."""
    store, place = _place(spark, path)
    store.delete(place, True)


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (under root), modified, length of all files under root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return files.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind of what differs between two listings (path, modified, length): added, changed (time or length) or gone.

    A path is listed once in each; rows without a path say nothing.
    """
    old, new = (x.filter("path IS NOT NULL").select("path", F.struct("modified", "length").alias(n)) for x, n in ((before, "old"), (after, "new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return old.join(new, "path", "full_outer").select("path", kind.alias("kind")).filter("kind IS NOT NULL")


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (under root), modified, content (text) of all files under root; unreadable bytes become replacement marks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    return files.select(path.alias("path"), F.col("modificationTime").alias("modified"), F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "utf-8").alias("content"))


def indexed(files: DataFrame) -> DataFrame:
    """The rows of .md and .MD files in indexed categories."""
    return files.filter(F.col("path").rlike(r"\.(md|MD)$") & classify_path(F.col("path")).isin(*INDEXED))


def markdown_fragments(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """doc_id, category, file, line_start, line_end, content of the fragments of indexed files, or of those in paths (path).

    doc_id numbers fragments by file and line, as a hash of both: no task numbers the whole table.
    """
    files = indexed(scan(spark, root))
    files = files if paths is None else files.join(paths, "path", "left_semi")
    files = files.select(F.col("path").alias("doc_id"), F.col("content").alias("text"), classify_path(F.col("path")).alias("category"))
    found = fragments(files).join(files.select("doc_id", "category"), "doc_id").withColumnRenamed("doc_id", "file")
    return found.select(F.xxhash64("file", "line_start").alias("doc_id"), "category", "file", "line_start", "line_end", "content")


def assets(spark: SparkSession, root: str) -> DataFrame:
    """path, path_lower, pack, content of files under the behaviour and resource packs of the asset folder."""
    files = scan(spark, root).filter(F.col("path").rlike("^GameAssets/(behavior_packs|resource_packs)/"))
    return files.select("path", F.lower("path").alias("path_lower"), F.split("path", "/")[1].alias("pack"), "content")


def keep_assets(paths: DataFrame, column: str = "path") -> DataFrame:
    """The paths with kept: whether the cleaner leaves them. Nothing is deleted."""
    name = F.lower(F.element_at(F.split(column, "/"), -1))
    return paths.withColumn("kept", F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*KEEP_EXTENSIONS) | name.isin(*KEEP_NAMES))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, without carriage returns and blanks."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("word")).filter("word <> ''")


def parse_json(text: str) -> Any:
    """One document on the driver; comments are allowed, and of repeated keys the last counts."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m.group(1) or "", text)
    return json.loads(plain)


def pretty(tree: Any, indent: int = 2) -> str:
    return json.dumps(tree, indent=indent, ensure_ascii=False, sort_keys=True)


def write_json(spark: SparkSession, trees: DataFrame, folder: str, indent: int = 2) -> None:
    """Writes each tree (path, json) to its own file under a folder on any store Spark writes to, laid out anew.

    A file is written beside its place and moved over it in one step, so a reader sees the old one or the new one. A path that
    leaves the folder raises, and so does a text that is no JSON; files before it are written then. Texts come to the driver
    one partition at a time.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    store, _ = _place(spark, folder)
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    for row in trees.select("path", "json").toLocalIterator():
        if ".." in row["path"] or row["path"].startswith("/"):
            raise ValueError(f"not a path under the folder: {row['path']!r}")
        body = pretty(parse_json(row["json"]), indent).encode()
        place, beside = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['path']}{end}") for end in ("", ".new"))
        out = store.create(beside, True)
        out.write(body)
        out.close()
        files.rename(beside, place, over)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files, by Spark's image source."""
    from tarnstone.operators.raster import from_images

    return from_images(spark.read.format("image").load(path))
