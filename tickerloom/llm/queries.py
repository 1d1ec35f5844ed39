"""The queries of this folder and their SQL twins."""

from __future__ import annotations

from tickerloom.llm import (
    op1_decontaminate,
    op2_bpe,
    op3_quality,
    op4_token_files,
    op5_toxicity,
    op6_substrings,
    op7_rules,
    op8_suffixes,
    op9_jaccard,
    op10_licences,
    op11_turn_repair,
    op12_whitening,
    op13_chat_format,
)

QUERIES = {
    "op1_decontaminate": op1_decontaminate.op1_decontaminate,
    "op2_bpe": op2_bpe.op2_bpe,
    "op3_quality": op3_quality.op3_quality,
    "op4_token_files": op4_token_files.op4_token_files,
    "op5_toxicity": op5_toxicity.op5_toxicity,
    "op6_substrings": op6_substrings.op6_substrings,
    "op7_rules": op7_rules.op7_rules,
    "op8_suffixes": op8_suffixes.op8_suffixes,
    "op9_jaccard": op9_jaccard.op9_jaccard,
    "op10_licences": op10_licences.op10_licences,
    "op11_turn_repair": op11_turn_repair.op11_turn_repair,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_chat_format": op13_chat_format.op13_chat_format,
}

ORACLES: dict[str, str] = {"op1_decontaminate": op1_decontaminate.ORACLE, "op6_substrings": op6_substrings.ORACLE, "op9_jaccard": op9_jaccard.ORACLE}
