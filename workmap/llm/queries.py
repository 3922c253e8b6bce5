"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workmap.llm import chat_windows, decontaminate, lattice_dedup, lm_score, mixing, ngram_jaccard, ranked_search, source_divergence, substring_dedup, suffix_dedup, token_count, toxicity, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_ngram_jaccard": ngram_jaccard.query,
        "op3_lm_score": lm_score.query,
        "op3_lm_score_bigrams": lm_score.query_bigrams,
        "op4_url_rules": url_rules.query,
        "op5_lattice_dedup": lattice_dedup.query,
        "op6_token_count": token_count.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_mix_sources": mixing.query,
        "op10_toxicity": toxicity.query,
        "op11_chat_windows": chat_windows.query,
        "op12_ranked_search": ranked_search.query,
        "op13_source_divergence": source_divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op2_ngram_jaccard": ngram_jaccard.ORACLE,
        "op3_lm_score": lm_score.ORACLE,
        "op3_lm_score_bigrams": lm_score.ORACLE_BIGRAMS,
        "op5_lattice_dedup": lattice_dedup.ORACLE,
        "op7_suffix_dedup": suffix_dedup.ORACLE,
        "op8_substring_dedup": substring_dedup.ORACLE,
        "op9_mix_sources": mixing.ORACLE,
        "op11_chat_windows": chat_windows.ORACLE,
        "op12_ranked_search": ranked_search.ORACLE,
        "op13_source_divergence": source_divergence.ORACLE,
    }
