"""Lines, fragments, directory listings and ranges of text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A heading of two to four hashes starts a fragment.
HEADING = "^#{2,4}([^#]|$)"


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line without its carriage return. No line follows a final line feed."""
    body = F.regexp_replace("text", r"\n\z", "")
    return docs.select("doc_id", F.posexplode(F.split(body, "\n", -1)).alias("i", "raw")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.regexp_replace("raw", r"\r\z", "").alias("line"))


def fragments(docs: DataFrame, boundary: str = HEADING) -> DataFrame:
    """doc_id, frag_no, line_start, line_end, content: text cut before each boundary line; fragments without text are dropped.

    line_end of a fragment that another follows is that one's first line, as in the system this stands in for.
    """
    lines = split_lines(docs)
    by_doc = Window.partitionBy("doc_id").orderBy("line_no")
    starts = F.col("line").rlike(boundary) & (F.length("line") >= 2)
    numbered = lines.withColumn("frag_no", F.sum(F.when(starts, 1).otherwise(0)).over(by_doc))
    pieces = numbered.groupBy("doc_id", "frag_no").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("last"), F.max(F.length("line")).alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    end = F.coalesce(F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("frag_no")), F.col("last"))
    return pieces.withColumn("line_end", end).filter("longest > 0").select("doc_id", F.col("frag_no").cast("long").alias("frag_no"), "line_start", "line_end", F.concat("content", F.lit("\n")).alias("content"))


def read_range(docs: DataFrame, start: int, end: int) -> DataFrame:
    """doc_id, content of the lines start..end (from 1, both included), total_lines of the whole text."""
    start = max(1, start)
    end = max(start, end)
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)
    return docs.select("doc_id", F.array_join(F.slice(lines, start, end - start + 1), "\n").alias("content"), F.size(lines).cast("long").alias("total_lines"))


def list_dir(paths: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """kind, name: the distinct directories and files right under a prefix."""
    prefix = prefix.replace("\\", "/")
    prefix = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    rest = F.substr(column, F.lit(len(prefix) + 1))
    found = paths.filter(F.startswith(F.col(column), F.lit(prefix))).select(F.when(F.contains(rest, F.lit("/")), "dir").otherwise("file").alias("kind"), F.substring_index(rest, "/", 1).alias("name"))
    return found.filter("name != ''").distinct()
