"""The queries over the dealt operators and their SQL, for the entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streamquarry.llm import byte_cnn, de_bruijn, exact_dedup, fill_middle, importance_resampling, jaccard_join, language_id, line_chunks, mixing, ngram_filter, packing, quality_rules, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_best_fit_packing": packing.query,
        "op3_quality_classifier": byte_cnn.query,
        "op4_mixing": mixing.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_quality_rules": quality_rules.query,
        "op7_sharding": sharding.query,
        "op8_language_id": language_id.query,
        "op9_line_dedup": line_chunks.query,
        "op10_lm_scoring": ngram_filter.query,
        "op11_substring_dedup": de_bruijn.query,
        "op12_fill_in_middle": fill_middle.query,
        "op13_importance_resampling": importance_resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op11_substring_dedup": de_bruijn.SQL,
        "op12_fill_in_middle": fill_middle.SQL,
    }
