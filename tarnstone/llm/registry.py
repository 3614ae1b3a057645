"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnstone.llm import bpe_codec, decontaminate, html_text, line_dedup, ngram_join, pii, quality_rules, source_mix, spelling, suffix_dedup, token_counts, vector_codes, window_dedup

Query = Callable[[SparkSession, str], DataFrame]



def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": line_dedup.query,
    "op2_pii": pii.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_ngram_join": ngram_join.query,
    "op5_token_counts": token_counts.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality_rules": quality_rules.query,
    "op8_window_dedup": window_dedup.query,
    "op9_bpe_codec": bpe_codec.query,
    "op10_html_text": html_text.query,
    "op11_source_mix": source_mix.query,
    "op12_vector_codes": vector_codes.query,
    "op13_spelling_variants": spelling.query,
    "pipeline": _pipeline,
}

from tarnstone.llm.oracles import ORACLE_SQL  # noqa: E402, F401
