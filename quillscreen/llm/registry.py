"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from quillscreen.llm import ball_trees, byte_pairs, chat_format, decontaminate, language_id, pieces, pii, quality_rules, secrets, simhash, suffix_dedup, token_counts, whitening

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_secrets": secrets.op4_secrets,
    "op5_pii": pii.op5_pii,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_simhash": simhash.op9_simhash,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_ball_trees": ball_trees.op11_ball_trees,
    "op12_byte_pairs": byte_pairs.op12_byte_pairs,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op3_chat_format": chat_format.SQL,
    "op7_quality_rules": quality_rules.SQL,
}
