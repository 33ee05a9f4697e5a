"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from scriptorium.llm import bpe, chat_format, language_id, mixing, near_dedup, nearest, parity_join, periodic_runs, quality_classifier, quality_rules, substring_dedup, token_counts, whitening


def queries() -> dict:
    found = [
        language_id.op1_language_id,
        bpe.op2_bpe_roundtrip,
        quality_rules.op3_quality_rules,
        quality_classifier.op4_quality_classifier,
        mixing.op5_source_mixing,
        chat_format.op6_chat_rotation,
        near_dedup.op7_near_dedup,
        substring_dedup.op8_substring_dedup,
        nearest.op9_nearest,
        token_counts.op10_token_counts,
        periodic_runs.op11_periodic_runs,
        whitening.op12_embedding_whitening,
        parity_join.op13_jaccard_join,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": mixing.oracle(), "op6_chat_rotation": chat_format.ORACLE, "op9_nearest": nearest.ORACLE}
