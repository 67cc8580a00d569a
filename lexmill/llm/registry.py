"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import license_scan, line_dedup, minhash_dedup, mixing, ppm_lm, quality_rules, sentencepiece_codec, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_mixing": mixing.op2_mixing,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_ppm_lm": ppm_lm.op7_ppm_lm,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op4_topk_search": topk_search.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
}
