"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import op01_mixing, op02_jaccard_join, op03_licenses, op04_substring_dedup, op05_decontamination, op06_language, op07_tokens, op08_hmm, op09_secrets, op10_quality, op11_search, op12_suffixes, op13_merkle

QUERIES = {"op1_mixing": op01_mixing.op1_mixing, "op2_jaccard_join": op02_jaccard_join.op2_jaccard_join, "op3_licenses": op03_licenses.op3_licenses, "op4_substring_dedup": op04_substring_dedup.op4_substring_dedup, "op5_decontamination": op05_decontamination.op5_decontamination, "op6_language": op06_language.op6_language, "op7_tokens": op07_tokens.op7_tokens, "op8_hmm": op08_hmm.op8_hmm, "op9_secrets": op09_secrets.op9_secrets, "op10_quality": op10_quality.op10_quality, "op11_search": op11_search.op11_search, "op12_suffixes": op12_suffixes.op12_suffixes, "op13_merkle": op13_merkle.op13_merkle}
ORACLES: dict[str, str] = {"op1_mixing": op01_mixing.oracle(), "op2_jaccard_join": op02_jaccard_join.ORACLE, "op4_substring_dedup": op04_substring_dedup.ORACLE, "op5_decontamination": op05_decontamination.ORACLE, "op10_quality": op10_quality.ORACLE, "op11_search": op11_search.ORACLE, "op12_suffixes": op12_suffixes.ORACLE, "op13_merkle": op13_merkle.ORACLE}
