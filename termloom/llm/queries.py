"""Queries of the training-data operators, and their SQL where SQL can express the whole result."""

from __future__ import annotations

from . import licences, lines, lsa, mix, near, phrases, pii, quality, tokens, toxicity

QUERIES = {
    "op1_substring_dedup": phrases.op1_substring_dedup,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": lsa.op3_decontaminate,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_near_dedup": near.op6_near_dedup,
    "op7_licence_scan": licences.op7_licence_scan,
    "op8_mix_sources": mix.op8_mix_sources,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE = {
    "op1_substring_dedup": phrases.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op6_near_dedup": near.ORACLE,
    "op8_mix_sources": mix.ORACLE,
}
