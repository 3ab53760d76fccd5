"""Queries and SQL of this package, by name."""

from __future__ import annotations

from spokes.llm import q03, q04, q05, q06, q07, q09, q10, q_tokens

QUERIES = {
    "op1_token_counts": q_tokens.op1_token_counts,
    "op2_token_store": q_tokens.op2_token_store,
    "op3_substring_dedup": q03.op3_substring_dedup,
    "op4_byte_bpe": q04.op4_byte_bpe,
    "op5_quality_rules": q05.op5_quality_rules,
    "op6_decontamination": q06.op6_decontamination,
    "op7_jaccard_join": q07.op7_jaccard_join,
    "op8_secret_scan": q_tokens.op8_secret_scan,
    "op9_quality_classifier": q09.op9_quality_classifier,
    "op10_chat_formatting": q10.op10_chat_formatting,
}
ORACLE_SQL = {"op6_decontamination": q06.SQL, "op3_substring_dedup": q03.SQL, "op5_quality_rules": q05.SQL, "op10_chat_formatting": q10.SQL}
