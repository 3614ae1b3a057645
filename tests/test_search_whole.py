"""Term frequencies and posting lists of every term, against plain Python on a small fixture."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnstone.operators import search as S


def test_every_term_is_returned(spark, tmp_path):
    texts = {1: "the nation ate tion cake the end", 2: "cake and thyme", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, t): n for d, text in texts.items() for t, n in Counter((text or "").split()).items()}
    rows = entry.queries()["term_frequency"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.term): r.tf for r in rows} == want and len(rows) == len(want)
    lists = {r.term: r.postings for r in entry.queries()["inverted_index"](spark, str(tmp_path)).collect()}
    assert lists == {t: " ".join(f"{d}:{want[d, t]}" for d in sorted(d for d, x in want if x == t)) for t in {t for _, t in want}}


def test_a_fallback_cuts_texts_for_both_queries_at_once(spark):
    docs = spark.createDataFrame([(1, "The cat, the Dog"), (2, "a dog and a cat"), (3, None), (4, "É Kat cat_x")], "doc_id long, text string")
    rows = lambda df: sorted((r.doc_id, round(r.score, 9), r.phase) for r in df.collect())
    for first, second in ((["none"], ["cat", "the"]), (["dog"], ["cat"]), (["none", "dog"], ["dog", "cat"]), ([], ["dog"]), (["none"], []), (["none"], ["nor"])):
        assert rows(S.bm25_fallback(docs, first, second)) == rows(S.fallback(S.bm25(docs, first), S.bm25(docs, second)))
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        cuts.add(1)
        return text

    seen = docs.withColumn("text", said("text"))
    import tarnstone.plans.base as base
    from tarnstone.plans.registry import QUERIES

    kept, base.table = base.table, lambda *_: seen
    try:
        assert QUERIES["search_fallback"](spark, "").count() == 1
    finally:
        base.table = kept
    assert 0 < cuts.value <= 8
