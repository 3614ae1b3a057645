"""A training-data pipeline of five stages over documents; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm import bpe_codec, decontaminate, line_dedup, ngram_join, quality_rules
from tarnstone.llm.common import read_table, stage, unstage

#: SQL cannot express the first and the last stage; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL: str | None = None


def _packed(docs: DataFrame, *by: str) -> DataFrame:
    """key, row, and the columns that an operator reads. Rows that agree in id, text and `by` have one key, also without an id."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text", *by) if c in docs.columns]
    none: list[Column] = [F.col(c).isNull() for c in ("doc_id", *by) if c in docs.columns]
    return docs.select(F.xxhash64(*said, *none).alias("key"), F.struct(*docs.columns).alias("row"), F.col("text"), *[F.col(c) for c in by if c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Each row is judged, also without an id; null and empty texts are rejected;
    repeated rows fare alike; an empty table gives an empty one."""
    rows = _packed(docs, "lang", "source")
    rejected = quality_rules.judge(rows, id_col="key").filter("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(rejected, "key", "left_anti").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier line go, and documents that have no words left by that; n_chars follows the text.

    Null and empty texts stay; rows that repeat an id and its text share the decision; other texts of one id, and texts
    without one, are documents of their own; other columns stay as they are; an empty table gives an empty one.
    """
    out = line_dedup.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one of the least doc_id (without one: before all others).

    Documents without words are linked with nothing and stay; of rows that repeat an id and its text one stays; texts that
    share an id, or have none, are documents of their own; an empty table gives an empty one.
    """
    rows = _packed(docs)
    found = ngram_join.near_duplicates(rows, id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    one = rows.dropDuplicates(["key"])
    first = found.join(one.select("key", F.col("row.doc_id").alias("doc_id")), "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "key"))["key"].alias("key"))
    return one.join(first.select("key"), "key", "left_semi").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. Texts are judged one by one, also where several share an id or have none; null
    and empty texts stay; an empty table on either side changes nothing."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the identifiers and of what they decode to, for every row left; a null text has no tokens."""
    return bpe_codec.encode_decode(docs, digests=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
