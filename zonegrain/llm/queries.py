"""Queries of this subpackage by name, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonegrain.llm import bpe, exact_dedup, fingerprints, html_text, jaccard_join, language_model, merkle, mixing, packing, quality, runs, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_language_model": language_model.op10_language_model,
    "op11_bpe": bpe.op11_bpe,
    "op12_merkle": merkle.op12_merkle,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_fingerprints": fingerprints.ORACLE,
    "op5_url_rules": url_rules.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_periodic_runs": runs.ORACLE,
}
